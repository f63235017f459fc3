"""Extraction over a table of files: one Arrow pass, symbols and edges from the same walk."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import extract

SYMBOL = "qualified_name string, name string, kind string, file_path string, language string, start_line int, end_line int, signature string, exported int, metadata string"
EDGE = "source string, target string, type string, weight double, metadata string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _arrow(schema: str) -> pa.StructType:
    return pa.struct([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))])


def extracted(files: DataFrame) -> DataFrame:
    """``symbol, edge`` (structs, one of them null) from ``path, language, text``; null texts have no symbols. Files are dealt by path, since a small input that makes many texts comes in few splits."""
    symbol, edge = _arrow(SYMBOL), _arrow(EDGE)

    def run(batches):
        for batch in batches:
            symbols, edges = [], []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None:
                    page = extract(path, language, text)
                    symbols += [{"file_path": path, "language": language, **s} for s in page.symbols.values()]
                    edges += page.edges
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(symbols, symbol), none(len(edges), symbol)]), pa.concat_arrays([none(len(symbols), edge), pa.array(edges, edge)])], ["symbol", "edge"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: texts that compress well would be put together into one task again
    return files.select("path", "language", "text").repartition(parts, "path").mapInArrow(run, f"symbol struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>")


def graph_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``symbols`` and ``edges`` of what ``extracted`` found (best stored first); channels of several files are one."""
    symbols = found.where("symbol is not null").select("symbol.*")
    channel = symbols.where("kind = 'channel'").dropDuplicates(["qualified_name"])
    edges = found.where("edge is not null").select("edge.*")
    one = edges.groupBy("source", "target", "type").agg(F.max("weight").alias("weight"), F.max("metadata").alias("metadata"))
    return symbols.where("kind <> 'channel'").unionByName(channel), one
