"""Secret findings in lines: known shapes, assignments of literals to sensitive names, sensitive references; redacted."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, line int, kind string, label string, severity string, confidence string, redacted string, evidence string, reason string"
RANK = {"low": 1, "medium": 2, "high": 3}
#: White space that values are trimmed of.
_WS = "\t\n\v\f\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

#: Shapes, names and markers of secrets.
_SHAPES = [
    (kind, label, severity, re.compile(pattern, re.ASCII), reason)
    for kind, label, severity, pattern, reason in (
        ("aws_access_key", "AWS access key id", "high", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "matches an AWS access key id shape"),
        ("github_token", "GitHub token", "high", r"\b(?:gh[pousr]_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{20,}_[A-Za-z0-9_]{20,})\b", "matches a GitHub token shape"),
        ("openai_key", "OpenAI API key", "high", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", "matches an OpenAI API key shape"),
        ("stripe_live_key", "Stripe live key", "high", r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}\b", "matches a Stripe live secret key shape"),
        ("slack_token", "Slack token", "high", r"\bxox[baprs]-[A-Za-z0-9-]{16,}\b", "matches a Slack token shape"),
        ("private_key", "Private key marker", "high", r"-----BEGIN [A-Z0-9 ]+ PRIVATE KEY-----", "contains a private key block marker"),
        ("jwt", "JWT-like token", "medium", r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{8,}\b", "matches a three-part JWT token shape"),
    )
]
_I = re.ASCII | re.IGNORECASE
_ASSIGNMENT = re.compile(
    r"""["']?([A-Za-z0-9_.-]*(?:api[_-]?key|secret|token|password|passwd|pwd|credential|client[_-]?secret|access[_-]?key)[A-Za-z0-9_.-]*)["']?[WS]*[:=][WS]*(["'`]?)([^"'`,WS#;]+)\2""".replace("WS", _WS), _I
)
_MEDIUM = re.compile(r"password|passwd|pwd|client[_-]?secret|access[_-]?key|secret", _I)
_QUALIFIERS = {"auth", "access", "refresh", "session", "bearer", "api", "github", "gitlab", "slack", "stripe", "openai", "jwt"}
_TYPES = {"string", "number", "boolean", "unknown", "object", "undefined", "function"}
_PLACEHOLDERS = ("example", "sample", "placeholder", "dummy", "minimum", "changeme", "replace", "redacted", "your_", "your-", "todo", "fake", "${", "process.env", "import.meta.env", "deno.env", "\\(", "<", ">", "...", "***")
_PLACEHOLDER = re.compile(r"[xX]{6,}|\*{6,}|__.*__")
_CONSTANT, _CLOUD_ID = re.compile(r"[A-Z][A-Z0-9_]{7,}"), re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_CODE, _NAME = re.compile(r"[()[\]{}!?]"), re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.][A-Za-z_$][A-Za-z0-9_$]*)*")
_REFERENCE = re.compile(r"\b(?:api[_-]?key|password|passwd|credential|credentials|client[_-]?secret|access[_-]?key)\b|\b(?:auth|access|refresh|session|bearer|github|gitlab|slack|stripe|openai|gh)[_-]?token\b", _I)
_SECRET, _SETTING = re.compile(r"\bsecret\b", _I), re.compile(r"\b(?:env|config|credential|key|token|password|value|var|variable|process)\b", _I)
#: Every line with a finding has one of these; the others never reach Python.
_CANDIDATE = r"(?i)key|secret|token|passw|pwd|credential|[sr]k_live_|sk-|xox|AKIA|ASIA|gh[pousr]_|github_pat_|eyJ|process\.env|import\.meta\.env"
_TEST_PATH = r"(?i)(^|/)[^/]*(test|tests|spec|specs|fixture|fixtures|mock|mocks)(/|$)|(^|/)(__tests__|__mocks__)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"


def sensitive_key(key: str) -> bool:
    words = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key).lower()) if p]
    parts = set(words)
    if parts & {"password", "passwd", "pwd", "credential", "credentials", "secret"} or ("key" in parts and parts & {"api", "access"}):
        return True
    return "token" in parts and (len(words) == 1 or bool(parts & _QUALIFIERS))


def placeholder(value: str) -> bool:
    v, lower = value.strip(_WS), value.strip(_WS).lower()
    return (
        _units(v) < 8 or lower in _TYPES or any(p in lower for p in _PLACEHOLDERS) or ("min-" in lower and "char" in lower) or lower.startswith(("env.", "config.", "settings."))
        or bool(_PLACEHOLDER.fullmatch(v)) or bool(_CONSTANT.fullmatch(v) and not _CLOUD_ID.fullmatch(v))
    )


def _units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def _cut(text: str, a: int | None, b: int | None) -> str:
    return text[a:b] if text.isascii() else text.encode("utf-16-le")[None if a is None else 2 * a : None if b is None else 2 * b].decode("utf-16-le", "replace")


def redact(value: str) -> str:
    v = value.strip(_WS)
    n = _units(v)
    return "[redacted]" if n <= 16 else f"{_cut(v, None, min(4, n // 3))}...{_cut(v, -4, None)}"


def _clip(text: str) -> str:
    t = text.strip(_WS)
    return _cut(t, None, 177) + "..." if _units(t) > 180 else t


def findings(text: str) -> list[tuple[str, ...]]:
    """(kind, label, severity, confidence, redacted, evidence, reason) of a line: shapes, assignments, then references."""
    out: dict[tuple, tuple] = {}

    def add(kind, label, severity, confidence, value, reason):
        redacted = redact(value)
        evidence = _clip(text.replace(value, redacted))
        out.setdefault((kind, redacted, evidence), (kind, label, severity, confidence, redacted, evidence, reason))

    for kind, label, severity, pattern, reason in _SHAPES:
        for m in pattern.finditer(text):
            add(kind, label, severity, "high", m[0], reason)
    for m in _ASSIGNMENT.finditer(text):
        key, quote, value = m.groups()
        if not sensitive_key(key) or placeholder(value) or (not quote and (_CODE.search(value) or _NAME.fullmatch(value))):
            continue
        severity = "medium" if _MEDIUM.search(key) else "low"
        add("sensitive_assignment", key, severity, severity, value, "sensitive-looking key assigned to a literal value")
    if not out:
        lower = text.lower()
        named = _REFERENCE.search(text) or (_SECRET.search(text) and _SETTING.search(text)) or any(x in lower for x in ("github.token", "process.env", "import.meta.env"))
        if named and not any(x in lower for x in ("your_", "your-", "placeholder", "example")):
            return [("sensitive_reference", "sensitive reference", "low", "low", "", _clip(text), "line references sensitive configuration without an obvious literal secret")]
    return list(out.values())


def scan(lines: DataFrame, *, min_confidence: str = "low", include_tests: bool = False) -> DataFrame:
    """All findings in ``path, line, text``; no limit. Lines under test-like paths are left out unless wanted."""
    least = RANK[min_confidence]

    def detect(batches):
        for batch in batches:
            rows = [(p, n, *f) for p, n, t in zip(*(c.to_pylist() for c in batch.columns)) for f in findings(t) if RANK[f[3]] >= least]
            columns = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.string()) for i, c in enumerate(columns)], [x.split()[0] for x in SCHEMA.split(", ")])

    wanted = lines if include_tests else lines.where(~F.col("path").rlike(_TEST_PATH))
    return wanted.where(F.col("text").rlike(_CANDIDATE)).select("path", F.col("line").cast("int"), "text").mapInArrow(detect, SCHEMA)


def ranked(found: DataFrame, *, limit: int = 50) -> DataFrame:
    """The findings to look at first: by confidence, severity, path and line."""
    rank = lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).otherwise(1)
    return found.orderBy(rank("confidence").desc(), rank("severity").desc(), "path", "line", "kind", "redacted").limit(max(1, min(500, limit)))


def risks(total) -> list[str]:
    """What the totals (a row of ``totals``) mean, in words."""
    said = [f"{total[k]} {k}-severity findings in {total['files']} files" for k in ("high", "medium") if total[k]]
    return said + (["only low-severity findings: look at them when their files change"] if total["findings"] and not said else [])


def totals(found: DataFrame) -> DataFrame:
    """One row: findings, by severity, and files with any."""
    return found.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")), F.countDistinct("path").alias("files"))
