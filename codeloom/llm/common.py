"""Shared plumbing of the corpus operators: shared-folder tables and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder of this machine is
    made and put into the session, so later calls find the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more; other frames are left alone."""
    for df in frames:
        spark = df.sparkSession
        home = shared_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(home.split(":", 1)[-1].lstrip("/") + "/"):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(rows: int, each: int = 50_000) -> int:
    """Partitions for a small table of ``rows`` rows, so that its rounds don't pay for the session's partitions."""
    return max(1, -(-rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def shards_for(texts: DataFrame, each: int, text: str = "text") -> int:
    """Number of key shards: the session's shuffle partitions, or more where a shard would get over ``each`` bytes of text."""
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))
