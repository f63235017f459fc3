"""Tables between the rounds of iterative operators: written to the folder that the session names, so that lost executors cost a round and no more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in ``spark.checkpoint.dir`` (a temporary folder on a local master only), read back."""
    spark = df.sparkSession
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        home = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", home)
    path = f"{home.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(files: DataFrame) -> DataFrame:
    """``files`` (path, text ..) in as many tasks as shuffles have: a small table that makes many texts, or texts that compress well, come in few splits. A given number, since texts that compress well would be put together into one task again."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "text")
