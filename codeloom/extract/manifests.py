"""Packages, dependencies, locked dependencies and configuration keys of manifest, lock and settings files."""

from __future__ import annotations

import json
import posixpath
import re


def _json(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _sections(text: str) -> list[tuple[str, str]]:
    """(header, body) of a TOML file's tables."""
    parts = re.split(r"(?m)^\s*\[([^\[\]]+)\]\s*$", text)
    return [("", parts[0]), *((h.strip(), b) for h, b in zip(parts[1::2], parts[2::2]))]


def _table(text: str, name: str) -> str:
    return next((body for head, body in _sections(text) if head == name), "")


def _toml_dependencies(body: str) -> list[tuple[str, str | None]]:
    out = []
    for line in body.splitlines():
        m = re.match(r"""([\w.-]+)\s*=\s*(?:"([^"]+)"|'([^']+)'|\{([^}]+)\})""", line.split("#", 1)[0].strip(), re.A)
        if m:
            inside = re.search(r"""version\s*=\s*["']([^"']+)["']""", m[4] or "")
            out.append((m[1], m[2] or m[3] or (inside[1] if inside else None)))
    return out


def _requirement(text: str) -> tuple[str, str | None]:
    m = re.match(r"\s*([A-Za-z0-9_.-]+)\s*(.*)$", text)
    return (m[1], m[2].strip() or None) if m else (text.strip(), None)


def _quoted(text: str) -> list[str]:
    return re.findall(r"""["']([^"']+)["']""", text)


def _named(pattern: str, text: str, flags: int = 0) -> str | None:
    m = re.search(pattern, text, flags)
    return m[1].strip() if m else None


_NAME = r"""(?m)^\s*name\s*=\s*["']([^"']+)["']"""


def _npm(text, ecosystem="npm"):
    spec = _json(text)
    keys = ("require", "require-dev") if ecosystem == "composer" else ("dependencies", "devDependencies", "peerDependencies")
    held = {k: v for key in keys for k, v in (spec.get(key) or {}).items()}
    return spec.get("name"), [(n, v, 1) for n, v in held.items() if n.lower() != "php"]


def _python(text):
    project, poetry = _table(text, "project"), _table(text, "tool.poetry")
    listed = re.search(r"(?m)^\s*dependencies\s*=\s*\[([\s\S]*?)\]", project)
    held = [_requirement(x) for x in _quoted(listed[1] if listed else "")]
    for line in _table(text, "project.optional-dependencies").splitlines():
        if m := re.match(r"\s*[\w.-]+\s*=\s*\[([^\]]*)\]", line):
            held += [_requirement(x) for x in _quoted(m[1])]
    for name in ("tool.poetry.dependencies", "tool.poetry.group.dev.dependencies"):
        held += _toml_dependencies(_table(text, name))
    return _named(_NAME, project) or _named(_NAME, poetry), [(n, v, 1) for n, v in held if n and n.lower() != "python"]


def _cargo(text):
    held = [x for name in ("dependencies", "dev-dependencies", "build-dependencies") for x in _toml_dependencies(_table(text, name))]
    return _named(_NAME, _table(text, "package")), [(n, v, 1) for n, v in held]


def _line(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


def _go(text):
    held = [(m[1], m[2], _line(text, m.start())) for m in re.finditer(r"(?m)^require[ \t]+([^\s()]+)[ \t]+(\S+)", text)]
    for block in re.finditer(r"(?m)^require\s*\(([\s\S]*?)^\)", text):
        held += [(m[1], m[2], _line(text, block.start())) for m in re.finditer(r"(?m)^[ \t]*([^\s]+)[ \t]+(\S+)", block[1])]
    return _named(r"(?m)^module\s+(\S+)", text), held


def _pubspec(text):
    from .kernel import _child_lines, _scalar

    lines = re.split(r"\r?\n", text)
    found = [(re.match(r"\s*([\w.-]+)\s*:", x), k) for _, k, x in _child_lines(lines, ["dependencies", "dev_dependencies", "dependency_overrides"])]
    return (_scalar(lines, "name") or (None,))[0], [(m[1], None, k) for m, k in found if m and m[1].lower() not in ("flutter", "sdk")]


def _pom(text):
    tag = lambda block, name: _named(rf"<{name}>([^<]+)</{name}>", block, re.I)
    joined = lambda block: ":".join(x for x in (tag(block, "groupId"), tag(block, "artifactId")) if x) if tag(block, "artifactId") else None
    project = re.search(r"<project[\s\S]*?</project>", text, re.I)
    held = [(joined(m[1]), tag(m[1], "version"), _line(text, m.start())) for m in re.finditer(r"<dependency>([\s\S]*?)</dependency>", text, re.I)]
    return joined(project[0] if project else text), [x for x in held if x[0]]


def _gradle(text):
    from .rules import GRADLE_DEPENDENCY

    name = _named(r"""rootProject\.name\s*=\s*["']([^"']+)["']""", text) or _named(r"""archivesBaseName\s*=\s*["']([^"']+)["']""", text)
    return name, [(f"{m[1]}:{m[2]}", m[3].strip() or None, _line(text, m.start())) for m in GRADLE_DEPENDENCY.finditer(text)]


def _mix(text):
    return _named(r"app:\s*:([A-Za-z_]\w*)", text), [(m[1], m[2], _line(text, m.start())) for m in re.finditer(r"""\{\s*:([A-Za-z_]\w*)\s*,\s*["']([^"']+)["']""", text)]


def _gemspec(text):
    held = re.finditer(r"""\.add_(?:runtime_|development_)?dependency\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", text)
    return _named(r"""\.name\s*=\s*["']([^"']+)["']""", text), [(m[1], m[2], _line(text, m.start())) for m in held]


def _requirements(text):
    found = [(re.fullmatch(r"([A-Za-z0-9_.-]+)\s*([<>=!~].*)?", x.split("#", 1)[0].strip()), k) for k, x in enumerate(re.split(r"\r?\n", text), 1)]
    return None, [(m[1], m[2], k) for m, k in found if m]


_MANIFESTS = {
    "package.json": ("npm", _npm), "composer.json": ("composer", lambda t: _npm(t, "composer")), "pyproject.toml": ("python", _python), "cargo.toml": ("cargo", _cargo),
    "go.mod": ("go", _go), "pubspec.yaml": ("dart", _pubspec), "pubspec.yml": ("dart", _pubspec), "pom.xml": ("maven", _pom), "build.gradle": ("gradle", _gradle),
    "build.gradle.kts": ("gradle", _gradle), "mix.exs": ("hex", _mix), "requirements.txt": ("python", _requirements),
}


def manifest(path: str, text: str):
    """(kind, name, line, metadata) of the package and the dependencies that a manifest names."""
    base = posixpath.basename(path).lower()
    ecosystem, read = ("ruby", _gemspec) if base.endswith(".gemspec") else _MANIFESTS.get(base, (None, None))
    if not read:
        return
    name, held = read(text)
    if name:
        yield "package", name, 1, {"ecosystem": ecosystem}
    for name, version, line in held:
        yield "dependency", name, line, {"ecosystem": ecosystem, **({"version": version} if version else {})}


# --- lock files ----------------------------------------------------------------------------------


def _version(v) -> str | None:
    return re.sub(r"\(.+\)$", "", re.sub("^v", "", v.strip())) or None if v else None


def _at(text: str, name: str) -> int:
    found = text.find(json.dumps(name))
    return _line(text, found) if found >= 0 else 1


def _npm_lock(text):
    spec = _json(text)
    held = [(v.get("name") or k.split("node_modules/")[-1].rstrip("/"), v.get("version")) for k, v in (spec.get("packages") or {}).items() if k]
    held = held or [(k, v.get("version")) for k, v in (spec.get("dependencies") or {}).items()]
    return [(n, v, _at(text, n)) for n, v in held if n]


def _composer_lock(text):
    spec = _json(text)
    return [(x["name"], x.get("version"), _at(text, x["name"])) for key in ("packages", "packages-dev") for x in spec.get(key) or [] if x.get("name")]


def _pnpm_lock(text):
    inside = False
    for k, line in enumerate(re.split(r"\r?\n", text), 1):
        if re.fullmatch(r"packages:\s*", line):
            inside = True
        elif inside and line[:1].strip():
            return
        elif inside and (m := re.match(r"""  ["']?([^"':]+[@/][^"':]+)["']?\s*:""", line)):
            key = re.sub(r"\(.+\)$", "", m[1].strip("\"'").removeprefix("/"))
            head, _, tail = key.rpartition("/")
            if not (head and tail[:1].isdigit()):
                head, _, tail = key.rpartition("@")
            if head:
                yield head, tail, k


def _yarn_lock(text):
    name = None
    for k, line in enumerate(re.split(r"\r?\n", text), 1):
        if m := re.fullmatch(r'("?[^#\s][^:]*"?):\s*', line):
            first = re.split(r",\s*", m[1].strip('"'))[0]
            name, at = first[: first.rfind("@")] if first.rfind("@") > 0 else first, k
        elif name and (m := re.match(r'\s+version\s+"([^"]+)"', line)):
            yield name, m[1], at
            name = None


def _package_tables(text):
    for m in re.finditer(r"\[\[package\]\]((?:(?!\n\[\[package\]\])[\s\S])*)", text):
        name, version = (_named(rf'(?m)^\s*{key}\s*=\s*"([^"]+)"', m[1]) for key in ("name", "version"))
        if name:
            yield name, version, _line(text, m.start())


def _go_sum(text):
    for k, line in enumerate(re.split(r"\r?\n", text), 1):
        if m := re.match(r"(\S+)\s+(\S+?)(?:/go\.mod)?\s+h1:", line.strip()):
            yield m[1], m[2], k


def _gem_lock(text):
    inside = False
    for k, line in enumerate(re.split(r"\r?\n", text), 1):
        if re.fullmatch(r"  specs:\s*", line):
            inside = True
        elif inside and line[:1].strip():
            return
        elif inside and (m := re.match(r"    ([A-Za-z0-9_.-]+)\s+\(([^)]+)\)", line)):
            yield m[1], m[2], k


_LOCKS = {
    "package-lock.json": ("npm", "npm", _npm_lock), "npm-shrinkwrap.json": ("npm", "npm", _npm_lock), "pnpm-lock.yaml": ("npm", "pnpm", _pnpm_lock), "pnpm-lock.yml": ("npm", "pnpm", _pnpm_lock),
    "yarn.lock": ("npm", "yarn", _yarn_lock), "composer.lock": ("composer", "composer", _composer_lock), "cargo.lock": ("cargo", "cargo", _package_tables), "poetry.lock": ("python", "poetry", _package_tables),
    "go.sum": ("go", "go", _go_sum), "gemfile.lock": ("ruby", "bundler", _gem_lock),
}


def locked(path: str, text: str) -> tuple[dict, list[tuple[str, str | None, int]]]:
    """What kind of lock file it is, and its (name, version, line); the first of equal names and versions counts."""
    ecosystem, manager, read = _LOCKS.get(posixpath.basename(path).lower(), (None, None, None))
    if not read:
        return {}, []
    held: dict[tuple, int] = {}
    for name, version, line in read(text):
        if name and name != "." and not name.startswith(("file:", "link:")):
            held.setdefault((name, _version(version)), line)
    return {"ecosystem": ecosystem, "packageManager": manager}, [(n, v, k) for (n, v), k in held.items()]


# --- configuration keys --------------------------------------------------------------------------

#: fixed values: words of keys that say nothing
STOP = frozenset("app application config configuration setting settings value values default defaults".split())


def key_words(key: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", key).lower()) if len(w) > 1 and w not in STOP]


def is_config(path: str, language: str) -> bool:
    whole = posixpath.normpath(path).lower()
    base = posixpath.basename(whole)
    stem, structured = re.sub(r"\.[^.]+$", "", base), language in ("json", "yaml", "toml")
    return bool(
        base.startswith(".env")
        or re.fullmatch(r"appsettings(?:\.[^.]+)?\.json|application(?:[-.][^.]+)?\.ya?ml|(?:config|settings)\.(?:json|ya?ml|toml)", base)
        or (structured and (re.search(r"(^|[._-])(?:config|settings)(?:[._-]|$)", stem) or re.search(r"/configs?/", whole)))
    )


def _usable(key: str) -> bool:
    key = key.strip()
    return bool(key) and len(key) <= 120 and "\0" not in key and bool(re.search("[A-Za-z]", key))


def _env(lines):
    for k, line in enumerate(lines, 1):
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", line, re.A):
            yield m[1], k


def _json_keys(text):
    def walk(value, path):
        if isinstance(value, dict):
            for key, child in value.items() if len(path) <= 4 else ():
                if _usable(key):
                    yield from walk(child, [*path, key])
        elif path and value is not None and not isinstance(value, list) and len(path) <= 4:
            yield ".".join(path), _at(text, path[-1])

    try:
        yield from walk(json.loads(text), [])
    except ValueError:
        return


def _toml_keys(lines):
    table: list[str] = []
    for k, line in enumerate(lines, 1):
        if m := re.fullmatch(r"\s*\[([^\]]+)\]\s*", line):
            table = [p.strip() for p in m[1].split(".") if _usable(p)]
        elif (m := re.match(r"\s*([\w.-]+)\s*=", line.split("#", 1)[0], re.A)) and _usable(m[1]):
            yield ".".join([*table, m[1]]), k


def _yaml_keys(lines):
    above: list[tuple[int, str]] = []
    for k, line in enumerate(lines, 1):
        m = re.fullmatch(r"(\s*)([A-Za-z0-9_.-]+)\s*:\s*(.*?)\s*(?:#.*)?", line)
        if not m or not _usable(m[2]):
            continue
        above = [(d, key) for d, key in above if d < len(m[1])]
        if m[3].strip() not in ("", "|", ">"):
            yield ".".join([*(key for _, key in above), m[2]]), k
        else:
            above.append((len(m[1]), m[2]))


def config_keys(path: str, language: str, text: str):
    """(key, line, kind of file, words) of a settings file; each place of a key once."""
    if not is_config(path, language):
        return
    lines = re.split(r"\r?\n", text)
    if posixpath.basename(path).lower().startswith(".env"):
        found, how = _env(lines), "env"
    else:
        found, how = {"json": (_json_keys(text), "json-config"), "toml": (_toml_keys(lines), "toml-config"), "yaml": (_yaml_keys(lines), "yaml-config")}.get(language, ((), ""))
    for key, line in dict.fromkeys(found):
        yield key, line, how, key_words(key)
