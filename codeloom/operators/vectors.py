"""Exact nearest vectors of many queries, scored block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES, VECTORS = 256, 4096  # most rows in a block of queries and of vectors


def _blocks(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Vectors packed into blocks of at most ``rows``: ``<prefix>ids, <prefix>data``."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                data = part.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}data"])

    usable = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return usable.mapInArrow(pack, f"{prefix}ids binary, {prefix}data binary")


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines, summed one dimension after the other: equal vectors get equal scores in every block."""
    dot, vv, qq = np.zeros((len(q), len(v))), np.zeros(len(v)), np.zeros(len(q))
    for x, y in zip(v.T, q.T):
        dot += y[:, None] * x
        vv += x * x
        qq += y * y
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(dot / np.sqrt(qq[:, None] * vv), -1, 1)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, *, limit: int = 20) -> DataFrame:
    """``query_id, vec_id, score``: for every row of ``queries`` the ``limit`` best of ``vectors``, the least vec_id first among equals.

    Rows without a cosine (no vector, or one of length 0) take no part.  Each pair of blocks keeps its own best, so
    what is shuffled is ``limit`` rows for each query and block of vectors.
    """

    def best(batches):
        for batch in batches:
            for vi, vd, qi, qd in zip(*(c.to_pylist() for c in batch.columns)):
                ids, of = np.frombuffer(vi, np.int64), np.frombuffer(qi, np.int64)
                by = np.argsort(ids, kind="stable")
                s = _scores(np.frombuffer(vd).reshape(len(ids), -1)[by], np.frombuffer(qd).reshape(len(of), -1))
                s[~np.isfinite(s)] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :limit]
                score = np.take_along_axis(s, top, 1)
                found = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(of[:, None], top.shape)[found]), pa.array(ids[by][top][found]), pa.array(score[found])], ["query_id", "vec_id", "s"])

    pairs = _blocks(vectors, VECTORS, "v").crossJoin(_blocks(queries, QUERIES, "q"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))
    rows = pairs.mapInArrow(best, "query_id long, vec_id long, s double").withColumn("rank", rank)
    return rows.where(F.col("rank") <= limit).select("query_id", "vec_id", F.round("s", 4).alias("score"))
