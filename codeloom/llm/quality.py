"""Operator 8: quality rules as weak supervision.

Each rule votes good, bad or abstains.  Documents with equal votes are alike to the
model, so Spark counts vote patterns (at most 3^rules, whatever the corpus) and
expectation-maximisation runs on that histogram: it estimates how each rule votes
on good text and on each kind of fault, and gives each pattern a posterior probability of
good text, which decides in place of an all-must-pass filter.

Edge cases: null and empty texts have no words and fail the base rules; null and repeated ids are rows of
their own; equal rows get equal verdicts; an empty table gives no rows (the model is then never applied); other columns are untouched.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored, table

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim")
WINDOW = 5
RUN_BYTES = 2_000_000  # texts measured together

_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(1, 2**63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = b" \t\n\x0b\x0c\r"
# how a byte counts in: code points outside white space, symbols, upper case, lower case, exclamation marks
_BYTES = np.zeros((256, 5), np.int64)
_BYTES[:, 0] = [(b & 0xC0) != 0x80 and b not in _SPACE for b in range(256)]
_BYTES[list(b"#*$%&|<>"), 1] = 1
_BYTES[65:91, 2] = 1
_BYTES[97:123, 3] = 1
_BYTES[33, 4] = 1


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), np.int64)
    number = defaultdict(itertools.count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t.split()), np.uint64) for t in texts]
    sizes = np.array([len(x) for x in ids], np.int64)
    out[:, 0] = sizes
    for k, t in enumerate(texts):
        counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _BYTES
        out[k, 1], out[k, 2], out[k, 6:9] = counts[0], counts[1], counts[2:]
        lines = [x for x in t.split(b"\n") if x.strip(_SPACE)]
        out[k, 3], out[k, 5] = len(lines) - len(set(lines)), len(lines)
    words, doc = np.concatenate(ids) if ids else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), sizes)
    n = len(words) - WINDOW + 1
    if n > 0:
        with np.errstate(over="ignore"):
            key = doc[:n].astype(np.uint64) * _ODD[WINDOW]
            for j in range(WINDOW):
                key += words[j : j + n] * _ODD[j]
        start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        key = key[start]
        ordered = np.sort(key)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            at = start[again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key]
            covered = np.zeros(len(words), bool)
            for j in range(WINDOW):
                covered[at + j] = True
            out[:, 4] = np.bincount(doc[covered], minlength=len(texts))
    return out


def features(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id`` and FEATURES of every whole text; ``row`` with all columns of ``df`` if wanted."""
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if keep else []
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), *row)
    names = ["doc_id", *(["row"] if keep else [])]

    def run(batches):
        for batch in batches:
            texts, parts, at, size = batch.column(1).to_pylist(), [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= RUN_BYTES or k == len(texts) - 1:
                    parts.append(measure(texts[at : k + 1]))
                    at, size = k + 1, 0
            found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.int64)
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, j]) for j in range(len(FEATURES)))], [*names, *FEATURES])

    schema = StructType([rows.schema[x] for x in names] + [StructField(x, LongType()) for x in FEATURES])
    return rows.mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: -1 bad, 1 good, 0 abstains.  Thresholds are those usual for web text."""
    c = F.col
    return {
        "length": _vote(c("n_words") < 10, c("n_words") >= 30),
        "word_length": _vote((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 12 * c("n_words"))),
        "symbols": _vote(10 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "repeats": _vote(100 * c("n_repeat_words") > 20 * c("n_words"), 100 * c("n_repeat_words") <= 15 * c("n_words")),
        "lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), 4 * c("n_dup_lines") <= c("n_lines")),
        "case": _vote(3 * c("n_upper") > c("n_lower"), 7 * c("n_upper") <= c("n_lower")),
        "shouting": _vote(10 * c("n_exclaim") > c("n_words"), 50 * c("n_exclaim") <= c("n_words")),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 200, smooth: float = 0.01, false_alarm: float = 0.01) -> tuple[dict[tuple[int, ...], float], dict]:
    """Expectation-maximisation on (votes, documents); returns each pattern's probability of good text, and the estimates.

    Text is good or has one of as many kinds of fault as there are rules (a page of symbols passes
    every other rule, so "bad" is not one class whose rules err independently).  The votes of each
    class are estimated; on good text no rule is taken to vote bad more often than ``false_alarm``.
    """
    if not patterns:
        return {}, {}
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    mass, n_rules = np.array([n for _, n in patterns], float), votes.shape[1]
    bad = (votes < 0).astype(float)
    kinds = bad + 1e-3  # pattern, kind of fault
    good = np.where(bad.any(axis=1), 0.1, 0.9)
    shares = np.column_stack([good, kinds * ((1 - good) / kinds.sum(axis=1))[:, None]])
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        weight = mass[:, None] * shares
        n = weight.sum(axis=0)
        rate = (n + smooth) / (n + smooth).sum()
        theta = (np.einsum("pc,prv->crv", weight, shown) + smooth) / (n[:, None, None] + 3 * smooth)
        alarm = np.minimum(theta[0, :, 0], false_alarm)
        theta[0, :, 1:] *= ((1 - alarm) / theta[0, :, 1:].sum(axis=1))[:, None]
        theta[0, :, 0] = alarm
        score = np.log(rate) + np.einsum("prv,crv->pc", shown, np.log(theta))
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, shares = np.abs(new - shares).max(), new
        if moved < 1e-9:
            break
    accuracy = {r: {"bad_votes_on_good": float(theta[0, r, 0]), "bad_votes_on_its_fault": float(theta[r + 1, r, 0])} for r in range(n_rules)}
    return {p: float(g) for (p, _), g in zip(patterns, shares[:, 0])}, {"good": float(rate[0]), "faults": rate[1:].tolist(), "rules": accuracy}


def quality(measured: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``measured`` (FEATURES, stored) with ``base_failed``, ``quality`` (posterior) and ``kept``."""
    votes = rules()
    named = measured.withColumn("_votes", F.concat_ws(",", *(v.cast("string") for v in votes.values())))
    counted = named.groupBy("_votes").count().collect()  # at most 3^rules rows
    patterns = sorted((tuple(map(int, r[0].split(","))), r[1]) for r in counted)
    posterior, _ = fit(patterns)
    spark = measured.sparkSession
    scores = spark.createDataFrame([(",".join(map(str, p)), g) for p, g in posterior.items()], "_votes string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = named.join(F.broadcast(scores), "_votes", "left").drop("_votes")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(features(table(spark, sf_dir, "documents")), "features")
    return quality(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict[str, str] = {}
