"""Text and vector retrieval over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored

K1, B = 1.2, 0.75


def code_lines(files: DataFrame) -> DataFrame:
    """``path, line, text``: non-blank lines, numbered from 1, at most 2000 characters."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "text"))
    return rows.where(F.trim("text") != "").select("path", (F.col("pos") + 1).alias("line"), F.substring("text", 1, 2000).alias("text"))


def bm25(files: DataFrame, terms: list[str], *, limit: int = 20) -> DataFrame:
    """``path, score`` of the best files for ``terms`` (letters and digits, any case): lengths and term counts come from one pass of native counting, no token is ever a row."""
    low, wanted = F.lower("text"), [t.lower() for t in terms]
    counts = [F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).alias(f"tf{i}") for i, t in enumerate(wanted)]
    docs = stored(files.select("path", F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), *counts).where("len > 0"), "term-counts")
    totals = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    rows = docs.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(totals))  # totals: one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def nearest_vectors(vectors: DataFrame, query_id: int, *, limit: int = 20) -> DataFrame:
    """``vec_id, score``: cosine to one stored vector, which is broadcast (one row)."""
    q = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    v = F.col("v")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(F.broadcast(q))
    score = F.try_divide(dot(v, F.col("q")), F.sqrt(dot(v, v) * dot(F.col("q"), F.col("q"))))  # null for vectors of length 0, which are near nothing
    return rows.select("vec_id", score.alias("s")).where("s IS NOT NULL").orderBy(F.desc("s"), "vec_id").limit(limit).select("vec_id", F.round("s", 4).alias("score"))
