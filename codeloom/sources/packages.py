"""Graph packages: the tables of a graph as Parquet with a manifest of counts and digests."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
MAX_MANIFEST = 16 * 1024
MAX_ROWS = 50_000_000


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest that does not depend on their order (sums of two 32-bit halves of each row's hash)."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))))
    n, a, b = df.select(row.alias("h")).agg(F.count("*"), F.coalesce(F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned("h", 32)), F.lit(0))).first()
    return n, f"{a:x}-{b:x}"


def export(tables: dict[str, DataFrame], path: str) -> dict:
    """Write ``tables`` to a new folder; it appears under ``path`` whole or not at all."""
    if os.path.exists(path):
        raise FileExistsError(path)
    made, manifest = f"{path}.{uuid.uuid4().hex}", {"version": VERSION, "tables": {}}
    try:
        for name, df in tables.items():
            df.write.parquet(f"{made}/{name}")
            rows, digest = fingerprint(df.sparkSession.read.parquet(f"{made}/{name}"))
            manifest["tables"][name] = {"rows": rows, "digest": digest}
        with open(f"{made}/manifest.json", "w") as f:
            json.dump(manifest, f, sort_keys=True)
        os.rename(made, path)
    finally:
        shutil.rmtree(made, ignore_errors=True)
    return manifest


def load(spark: SparkSession, path: str, *, max_rows: int = MAX_ROWS) -> dict[str, DataFrame]:
    """The tables of a package; ValueError if they are not what its manifest says."""
    file = f"{path}/manifest.json"
    if os.path.getsize(file) > MAX_MANIFEST:
        raise ValueError("the manifest is too large")
    with open(file) as f:
        manifest = json.load(f)
    if manifest.get("version") != VERSION or sum(t["rows"] for t in manifest["tables"].values()) > max_rows:
        raise ValueError("an unknown version, or more rows than allowed")
    out = {}
    for name, told in manifest["tables"].items():
        if not name.isidentifier():
            raise ValueError(f"{name!r} is no table name")
        out[name] = spark.read.parquet(f"{path}/{name}")
        if fingerprint(out[name]) != (told["rows"], told["digest"]):
            raise ValueError(f"table {name} is not what was packed")
    return out


def unpack(spark: SparkSession, path: str, home: str, *, overwrite: bool = False) -> dict[str, DataFrame]:
    """Copy a verified package to ``home``, which is replaced only if ``overwrite`` says so."""
    if os.path.exists(home) and not overwrite:
        raise FileExistsError(home)
    made = f"{home}.{uuid.uuid4().hex}"
    try:
        export(load(spark, path), made)
        shutil.rmtree(home, ignore_errors=True)
        os.rename(made, home)
    finally:
        shutil.rmtree(made, ignore_errors=True)
    return {name: spark.read.parquet(f"{home}/{name}") for name in os.listdir(home) if name != "manifest.json"}


def bootstrap(spark: SparkSession, path: str, home: str) -> bool:
    """Unpack ``path`` to ``home`` if there is a package and no graph yet."""
    if os.path.exists(home) or not os.path.exists(f"{path}/manifest.json"):
        return False
    unpack(spark, path, home)
    return True
