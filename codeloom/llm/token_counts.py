"""Operator 5: token counts by batch encoding in Arrow functions that return lengths only.

Edge cases: null and empty texts have no bytes and no tokens; repeated rows give repeated rows;
an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table, text_or_empty

BATCH_BYTES = 4_000_000


class Counter:
    """Lengths of encodings; one in each Python worker for each vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer, self.split, self.model = tokens.load(path), tokens.spaces_are_safe(path), path.endswith(".model")
        self.first, self.later = tokens.Memo(0), tokens.Memo(0)  # chunks at a text's start, and behind a space

    def encode(self, texts: list[str]) -> list[int]:
        if self.model:
            return [len(x) for x in self.tokenizer.encode(texts, num_threads=1)]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [len(x) for x in encode(texts, add_special_tokens=False)]

    def fill(self, memo: tokens.Memo, before: str) -> None:
        for run in tokens.by_bytes(list(set(memo.wanted)), len):
            memo.update(zip(run, self.encode([before + x for x in run])))
        memo.wanted.clear()

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [n for run in tokens.by_bytes(texts, len) for n in self.encode(run)]
        first, later, out, owed = self.first, self.later, [], []
        for memo in (first, later):
            memo.trim()
        for text in texts:
            head, *rest = tokens.safe_chunks(text)
            a, b = len(first.wanted), len(later.wanted)
            n = first[head] + sum(map(later.__getitem__, rest))
            owed.append((first.wanted[a:], later.wanted[b:]))
            out.append(n)
        self.fill(first, "")
        self.fill(later, " ")
        return [n + sum(map(first.__getitem__, x)) + sum(map(later.__getitem__, y)) for n, (x, y) in zip(out, owed)]


_COUNTERS: dict[str, Counter] = {}


def token_counts(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; the vocabulary file must lie at the same path on every worker."""
    path = vocabulary or tokens.public_path("byte_bpe_50k.json")
    rows = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(df, text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def lengths(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [n for run in tokens.by_bytes(texts, len, BATCH_BYTES) for n in counter(run)]
            n_bytes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  (so that pa.compute is there in the workers)

    def with_compute(batches):
        import pyarrow.compute  # noqa: F401

        yield from lengths(batches)

    out = rows.mapInArrow(with_compute, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE_SQL: dict[str, str] = {}
