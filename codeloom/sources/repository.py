"""A source tree as tables: files with language, skip reason and hash; their texts; their lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_FILES = 750_000, 20_000
MAX_RULE_BYTES, MAX_RULES, MAX_RULE = 64 * 1024, 2000, 500

# Folders, files and extensions that are never read.
IGNORED_FOLDERS = (
    ".git .hg .svn node_modules dist build out coverage .next .nuxt .turbo .cache .pnpm-store __pycache__ .pytest_cache .venv venv target vendor vendored artifacts DerivedData xcuserdata .swiftpm .gradle .build"
).split()
IGNORED_FILES = ["bun.lockb", "tsconfig.tsbuildinfo"]
BINARY = "png jpg jpeg gif webp ico pdf zip gz tgz tar bin wasm mp4 mov sqlite db".split()
# Languages by extension.
EXTENSIONS = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py", "go": "go", "java": "java", "rust": "rs", "swift": "swift", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx ipp",
    "csharp": "cs", "kotlin": "kt kts", "php": "php phtml", "dart": "dart", "terraform": "tf tfvars hcl", "qml": "qml", "apex": "cls trigger", "sql": "sql", "yaml": "yml yaml", "markdown": "md mdx",
    "json": "json jsonc", "toml": "toml", "xml": "xml", "graphql": "graphql gql", "proto": "proto", "gradle": "gradle", "ruby": "rb gemspec", "elixir": "ex exs", "shell": "sh bash zsh",
}
# Base names with a language of their own, and base names that are text all the same.
NAMED = {"go.mod": "go", "build.gradle": "gradle", "build.gradle.kts": "gradle", "mix.exs": "elixir", "gemfile": "ruby", "rakefile": "ruby", "dockerfile": "shell", "yarn.lock": "unknown", "cargo.lock": "unknown", "poetry.lock": "unknown", "gemfile.lock": "unknown"}
TEXT_NAMES = (
    "makefile license readme contributing security dockerfile go.mod go.sum yarn.lock cargo.lock poetry.lock gemfile.lock package-lock.json npm-shrinkwrap.json pnpm-lock.yaml pnpm-lock.yml composer.lock requirements.txt gemfile rakefile .gitignore .gitattributes"
).split()


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def built_in_ignored(path: Column, *, hidden: bool = False) -> Column:
    """Whether a folder on the way, or the file itself, is one that is never read."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    name = F.element_at(F.split(path, "/"), -1)
    out = F.exists(folders, lambda f: f.isin(IGNORED_FOLDERS) | (F.lit(not hidden) & f.startswith(".") & (f != ".github")))
    return out | name.isin(IGNORED_FILES) | F.lower(name).rlike(r"\.(" + "|".join(BINARY) + ")$")


def _glob(text: str) -> str:
    shapes = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(shapes.get(part) or re.escape(part) for part in re.findall(r"\*\*|\*|\?|[^*?]+", text))


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, kept) of the lines of an ignore file; ValueError beyond its limits."""
    if len(text.encode()) > MAX_RULE_BYTES:
        raise ValueError(f"an ignore file has at most {MAX_RULE_BYTES} bytes")
    lines = [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
    if len(lines) > MAX_RULES or any(len(x) > MAX_RULE for x in lines):
        raise ValueError(f"an ignore file has at most {MAX_RULES} rules of at most {MAX_RULE} characters")
    out = []
    for line in lines:
        glob = line.removeprefix("!").replace("\\", "/").removeprefix("./")
        body = glob.strip("/")
        start = "^" if "/" in body or glob.startswith("/") else "(?:^|/)"
        out.append((start + _glob(body) + ("(?:/.*)?$" if glob.endswith("/") else "$"), line.startswith("!")))
    return out


def custom_ignored(path: Column, text: str) -> Column:
    """Whether the last rule that fits a path, or a folder on its way, ignores it; folders that are ignored are not entered."""
    rules = ignore_rules(text)

    def judged(name: Column) -> Column:
        out = F.lit(False)
        for pattern, kept in rules:
            out = F.when(name.rlike(pattern), F.lit(not kept)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), "/").otherwise("")))
    return F.exists(above, judged) if rules else F.lit(False)


def language_overrides(spec: dict | None) -> list[tuple[str, str]]:
    """(suffix or base name, language), longest first."""
    languages = (spec or {}).get("languages", {})
    if not isinstance(languages, dict) or any(not k or "/" in k or v not in (*EXTENSIONS, "unknown") for k, v in languages.items()):
        raise ValueError("languages must map suffixes or base names to known languages")
    return sorted(((k.lower(), v) for k, v in languages.items()), key=lambda x: -len(x[0]))


def language_of(path: Column, overrides: list[tuple[str, str]] = ()) -> Column:
    base = base_name(path)
    out = F.when(F.lit(False), F.lit(""))
    for pattern, language in overrides:
        out = out.when(base.endswith(pattern) if pattern.startswith(".") else base == pattern, language)
    for name, language in NAMED.items():
        out = out.when(base == name, language)
    out = out.when(base.endswith(".dockerfile"), "shell").when(base.endswith(".rake"), "ruby")
    known = F.create_map(*(F.lit(x) for language, ends in EXTENSIONS.items() for e in ends.split() for x in (e, language)))
    # a name that only begins with a dot has no extension
    return out.otherwise(F.coalesce(F.try_element_at(known, F.regexp_extract(base, r"^.+\.([^.]*)$", 1)), F.lit("unknown")))


def is_text_candidate(path: Column, language: Column) -> Column:
    return (language != "unknown") | base_name(path).isin(TEXT_NAMES)


def skip_reason(path: Column, language: Column, size: Column, text: Column, *, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not indexed, null if it is."""
    return F.when(~is_text_candidate(path, language), "unsupported extension").when(size > max_bytes, f"larger than {max_bytes} bytes").when(text.isNull() | F.contains(text, F.lit("\0")), "binary or unreadable")


def files_of(raw: DataFrame, *, ignore: str = "", overrides: list[tuple[str, str]] = (), max_bytes: int = MAX_BYTES, hidden: bool = False) -> DataFrame:
    """``path, language, bytes, lines, sha256, skipped, skip_reason, text`` from ``path, content`` (binary)."""
    path = F.col("path")
    kept = raw.where(~built_in_ignored(path, hidden=hidden) & ~custom_ignored(path, ignore))
    named = kept.select("path", language_of(path, overrides).alias("language"), F.length("content").cast("long").alias("bytes"), "content", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    reason = skip_reason(path, F.col("language"), F.col("bytes"), F.col("text"), max_bytes=max_bytes)
    told = named.withColumn("skip_reason", reason).withColumn("skipped", F.col("skip_reason").isNotNull())
    whole = F.when(~F.col("skipped"), F.col("text"))
    lines = F.coalesce(F.size(F.split(whole, r"\r?\n", -1)), F.lit(0)).cast("int")
    return told.select("path", "language", "bytes", lines.alias("lines"), F.when(~F.col("skipped"), F.sha2("content", 256)).alias("sha256"), "skipped", "skip_reason", whole.alias("text"))


def _hidden(spark: SparkSession, root: str, max_files: int) -> DataFrame:
    """Files that Spark's readers pass over, because they or their folder begin with a dot or an underscore: few, so the driver reads them."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows, folders, home = [], [(at, "", False)], len(fs.makeQualified(at).toString().rstrip("/")) + 1
    while folders:
        folder, _, hidden = folders.pop()
        for status in fs.listStatus(folder):
            path = status.getPath()
            name, skips = path.getName(), hidden or path.getName()[:1] in "._"
            if status.isDirectory():
                if name not in IGNORED_FOLDERS:
                    folders.append((path, name, skips))
            elif skips:
                if len(rows) >= max_files:
                    raise ValueError(f"more than {max_files} hidden files under {root}")
                stream = fs.open(path)
                try:
                    body = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) if status.getLen() <= 4 * MAX_BYTES else None
                finally:
                    stream.close()
                rows.append((path.toString()[home:], bytearray(body) if body is not None else None))
    return spark.createDataFrame(rows, "path string, content binary")


def read_tree(spark: SparkSession, root: str, *, max_files: int = MAX_FILES, **options) -> DataFrame:
    """Files under ``root`` with paths relative to it; ValueError if more than ``max_files`` are left by the ignore rules."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    home = "/" + root.split(":", 1)[-1].strip("/") + "/"
    place = F.regexp_replace("path", r"^[a-zA-Z]+:/*", "/")
    found = raw.select(F.substring(place, len(home) + 1, 1_000_000).alias("path"), "content").unionByName(_hidden(spark, root, max_files))
    out = files_of(found, **options)
    if out.select("path").limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files under {root}")
    return out


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (added, changed, removed, unchanged) between two tables of ``path, sha256``."""
    a, b = old.select("path", F.col("sha256").alias("was")), new.select("path", F.col("sha256").alias("now"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.withColumn("had", F.lit(1)).join(b.withColumn("has", F.lit(1)), "path", "full").select("path", change.alias("change"))


def parsed_overrides(text: str) -> list[tuple[str, str]]:
    return language_overrides(json.loads(text))
