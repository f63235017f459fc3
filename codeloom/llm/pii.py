"""Operator 3 (native): personal data found by weak supervision.

Base patterns (email, ip, card, phone) give spans that stay.  Looser patterns add
candidates (secrets, phones without a plus sign, unpunctuated national numbers); labelers vote on every
candidate: its own shape, gazetteers (mail hosts, reserved networks, issuer prefixes, words
that mark a secret) and the words before it.  Candidates with equal votes are alike to the model,
so Spark counts vote patterns (a bounded number), expectation-maximisation on the
counts estimates each labeler's reliability, and a logistic classifier is trained on
votes, kind and shape (length, share of digits, what stands before) against the posteriors.  Its weights go back as a column expression.

Only DataFrame functions run on the executors; the two models are fitted by the driver on
the pattern counts.  Positions are code points, ends exclusive.

Edge cases: null and empty texts have no spans; very long runs of digits or letters cost linear time
(possessive patterns); null and repeated ids are rows of their own,
since spans never leave their row; equal rows get equal results; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: kind, pattern (possessive where that changes nothing but the time it takes), character a text must hold
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: added by the method: looser shapes that need votes
LOOSE = (
    ("secret", r"(?i:password|passwd|token|secret|api[_-]?key)\s?[:=]\s?[\"']?[A-Za-z0-9_+/-]{12,}+[\"']?", "="),
    ("key", r"\b[A-Z]{4}[A-Z0-9]{16}\b", None),
    ("number", r"\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", None),
)
CONTEXT_CHARS = 24
GAZETTEER_HOSTS = r"(?i)@(?:[a-z0-9-]+\.)*(?:com|org|net|edu|gov|io|de|fr|es|co|info|biz)$"
RESERVED_IP = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = r"(?i)(?:mail|contact|write|phone|tel|call|fax|card|visa|account|address|host|server|login|user|password|token|secret|key)[^\p{L}]{0,3}\p{L}{0,12}\W*$"
ANTI_CUES = r"(?i)(?:version|license|licence|isbn|page|chapter|section|fig|table|vol)\W*$"


def spans_of(text: Column, kind: str, pattern: str, mark: str | None) -> Column:
    """Array of (kind, start, stop, value) of all matches, leftmost and non-overlapping."""
    none = F.array().cast("array<string>")
    there = F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9]")
    found = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(there, F.split(text, pattern, -1)).otherwise(none)
    # the k-th match starts behind the first k gaps and the k-1 matches before it
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>")
    step = lambda done, x: F.struct(
        (done["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
        F.concat(done["spans"], F.array(F.struct(F.lit(kind).alias("kind"), (done["at"] + F.length(x["gap"])).alias("start"), (done["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("stop"), x["value"].alias("value")))).alias("spans"),
    )
    return F.when(F.size(found) > 0, F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda done: done["spans"])).otherwise(empty)


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(value, r"[^0-9]", "")), "")
    point = lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), point), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def valid(span: Column) -> Column:
    """The base kinds' own tests; other kinds pass."""
    value = span["value"]
    n = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    parts = F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(span["kind"] == "ip", parts)
        .when(span["kind"] == "card", F.when(n.between(14, 19), luhn(value)).otherwise(F.lit(False)))
        .when(span["kind"] == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def _clash(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def candidates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, base, extra``: spans that stay, and looser candidates (with the text before them) that overlap none of those; ``row`` with all columns if wanted."""
    row = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if keep else []
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *row)
    t = F.col("text")
    base = F.filter(F.concat(*(spans_of(t, *rule) for rule in BASE)), valid)
    loose = F.concat(*(spans_of(t, *rule) for rule in LOOSE))
    seen = docs.select(*docs.columns, base.alias("base"), loose.alias("loose"))
    context = lambda s: F.substring(F.col("text"), F.greatest(F.lit(1), s["start"] + 1 - CONTEXT_CHARS), F.least(s["start"], F.lit(CONTEXT_CHARS)))
    told = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), context(s).alias("before"))
    extra = F.filter("loose", lambda s: ~F.exists("base", lambda b: _clash(s, b)))
    return seen.select("doc_id", *(["row"] if keep else []), F.transform("base", told).alias("base"), F.transform(extra, told).alias("extra"))


def votes(span: Column) -> list[Column]:
    """1 personal, -1 not, 0 abstains; one column a labeler."""
    kind, value, before = span["kind"], span["value"], span["before"]
    pick = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    letters, digits = value.rlike("[A-Za-z]"), value.rlike("[0-9]")
    return [
        pick(kind.isin("email", "ip", "card", "phone"), F.lit(False)),  # strict pattern
        pick((kind == "secret") & letters & digits, (kind == "secret") & ~digits),  # entropy of a secret
        pick((kind == "key") & value.rlike("^(?:AKIA|ASIA|AIDA)"), F.lit(False)),  # gazetteer of key prefixes
        pick((kind == "email") & value.rlike(GAZETTEER_HOSTS), (kind == "ip") & value.rlike(RESERVED_IP)),  # gazetteer of hosts and networks
        pick((kind == "card") & F.regexp_replace(value, r"[^0-9]", "").rlike(ISSUER), F.lit(False)),  # gazetteer of issuers
        pick((kind == "number") & value.rlike(r"555|^\("), (kind == "number") & value.rlike(r"(\d)\1{5}")),  # number shape
        pick(before.rlike(CUES), before.rlike(ANTI_CUES)),  # context
    ]


LENGTHS, SHARES = 5, 5  # classes of a span's length and of its share of digits


def shape(span: Column) -> list[Column]:
    """What the classifier sees besides the votes: length in steps of eight, quarters of digits, whether a letter or digit goes on before the span."""
    value = span["value"]
    n = F.greatest(F.length(value), F.lit(1))
    digits = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    joined = span["before"].rlike(r"[\p{L}\p{N}]$")
    return [F.least(F.floor(n / 8), F.lit(LENGTHS - 1)).cast("int"), F.floor((SHARES - 1) * digits / n).cast("int"), joined.cast("int")]


def _indicators(length: int, share: int, joined: int) -> list[float]:
    return [*(float(length == i) for i in range(LENGTHS)), *(float(share == i) for i in range(SHARES)), float(joined)]


def fit_labelers(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 100, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation with one accuracy a labeler; posteriors of the patterns and the accuracies.

    Labelers are taken to be right more often than not (0.55 to 0.99), which fixes which class is which.
    """
    v = np.array([p for p, _ in patterns], float).reshape(len(patterns), -1)
    mass = np.array([n for _, n in patterns], float)
    accuracy, prior = np.full(v.shape[1], 0.8), 0.5
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-(v @ weight + np.log(prior / (1 - prior)))))
        right = (mass[:, None] * ((v > 0) * posterior[:, None] + (v < 0) * (1 - posterior[:, None]))).sum(axis=0)
        cast = (mass[:, None] * (v != 0)).sum(axis=0)
        accuracy = np.clip((right + 0.8 * smooth) / (cast + smooth), 0.55, 0.99)
        prior = float(np.clip((mass @ posterior + smooth) / (mass.sum() + 2 * smooth), 0.05, 0.95))
    return posterior, accuracy


def fit_classifier(x: np.ndarray, target: np.ndarray, mass: np.ndarray, *, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last: constant) of a logistic model for soft targets, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, share = np.zeros(x.shape[1]), mass / max(mass.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - target)) + ridge * w
        bend = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def detect(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: bool = False) -> DataFrame:
    """``doc_id, base, spans``: arrays of (kind, start, stop); spans are base's and the accepted candidates; ``row`` with all columns if wanted."""
    found = stored(candidates(documents, doc_id=doc_id, text=text, keep=keep), "spans")
    names, shapes = [f"v{i}" for i in range(7)], ("length", "share", "joined")
    each = found.select(F.explode(F.concat("base", "extra")).alias("s")).select(F.col("s.kind").alias("kind"), *(v.alias(n) for v, n in zip(votes(F.col("s")), names)), *(v.alias(n) for v, n in zip(shape(F.col("s")), shapes)))
    kinds = [k for k, *_ in BASE + LOOSE]
    # at most kinds * 3^labelers * shapes rows, whatever the corpus
    rows = sorted(each.groupBy("kind", *names, *shapes).count().collect(), key=lambda r: (r["kind"], *(r[n] for n in (*names, *shapes))))
    if rows:
        patterns: dict[tuple, int] = {}
        for r in rows:
            seen = tuple(r[n] for n in names)
            patterns[seen] = patterns.get(seen, 0) + r["count"]
        voted, _ = fit_labelers(list(patterns.items()))
        target = dict(zip(patterns, voted))
        x = np.array([[*(float(r[n]) for n in names), *(float(r["kind"] == k) for k in kinds), *_indicators(*(r[n] for n in shapes))] for r in rows])
        weights = fit_classifier(x, np.array([target[tuple(r[n] for n in names)] for r in rows]), np.array([r["count"] for r in rows], float)).tolist()
    else:
        weights = [0.0] * (len(names) + len(kinds) + LENGTHS + SHARES + 2)

    def score(span: Column) -> Column:
        total = F.lit(weights[-1])
        for w, v in zip(weights, votes(span)):
            total = total + F.lit(w) * v
        for w, k in zip(weights[len(names) :], kinds):
            total = total + F.when(span["kind"] == k, w).otherwise(0.0)
        rest = weights[len(names) + len(kinds) : -1]
        length, share, joined = shape(span)
        for i in range(LENGTHS):
            total = total + F.when(length == i, rest[i]).otherwise(0.0)
        for i in range(SHARES):
            total = total + F.when(share == i, rest[LENGTHS + i]).otherwise(0.0)
        return total + F.lit(rest[-1]) * joined

    # one place keeps one added span: later loose kinds yield to earlier ones
    order = {k: i for i, k in enumerate(kinds)}
    rank = lambda s: sum((F.when(s["kind"] == k, i).otherwise(0) for k, i in order.items()), F.lit(0))
    accepted = F.filter("extra", lambda s: score(s) >= float(np.log(threshold / (1 - threshold))))
    alone = F.filter("accepted", lambda s: ~F.exists("accepted", lambda o: _clash(s, o) & (rank(o) < rank(s))))
    bare = lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    out = found.withColumn("accepted", accepted).withColumn("alone", alone)
    return out.select("doc_id", *(["row"] if keep else []), F.array_sort(F.transform("base", bare)).alias("base"), F.array_sort(F.transform(F.concat("base", "alone"), bare)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def masked(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with every found span of ``text`` replaced by its kind in angle brackets; overlapping spans merge under the first one's kind."""
    found = detect(documents, doc_id=doc_id, text=text, keep=True)
    t, start = F.col(f"row.`{text}`"), lambda s: s["start"]
    step = lambda done, s: F.struct(
        F.when(start(s) >= done["at"], F.concat(done["out"], F.substring(t, done["at"] + 1, start(s) - done["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(done["out"]).alias("out"),
        F.greatest(done["at"], s["stop"]).alias("at"),
    )
    finish = lambda done: F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, finish)).otherwise(t)
    return found.select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in documents.columns))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(table(spark, sf_dir, "documents")))


QUERIES = {"op3_personal_data": op3_personal_data}
ORACLE_SQL: dict[str, str] = {}
