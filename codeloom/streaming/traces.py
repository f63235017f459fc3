"""Runtime traces as observed edges, in batch or as a stream; and a source tree that is indexed as it changes."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE = "type string, source string, sourceFile string, target string, targetFile string, method string, path string, channel string, direction string, edgeType string, count double, observedAt string"


def read_traces(spark: SparkSession, what: str) -> DataFrame:
    """Traces from a JSON file or from JSON itself: a list, or an object that holds one under ``traces``."""
    text = what
    if os.path.exists(what):
        with open(what) as f:
            text = f.read()
    found = json.loads(text)
    rows = found if isinstance(found, list) else found.get("traces", [found])
    names = [x.split()[0] for x in TRACE.split(", ")]
    clean = [tuple(None if r.get(n) is None else float(r[n]) if n == "count" else str(r[n]) for n in names) for r in rows]
    return spark.createDataFrame(clean, TRACE)


def weight(count: Column) -> Column:
    return F.least(F.greatest(F.coalesce(count, F.lit(1.0)), F.lit(1.0)), F.lit(1000.0)).cast("double")


def observed_edges(events: DataFrame) -> DataFrame:
    """``source, target, type, weight``: how often each user was seen on each channel, 1 to 1000."""
    ends = events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("channel:"), F.col("event_type")).alias("target"))
    return ends.groupBy("source", "target").agg(F.count("*").alias("n")).select("source", "target", F.lit("OBSERVED_EMITS").alias("type"), weight(F.col("n").cast("double")).alias("weight"))


def url_path(value: Column) -> Column:
    """The path of a url or of what stands for one."""
    v = F.trim(value)
    whole = F.when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_extract(v, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(v, r"^([^?#]*)", 1))
    return F.when(v == "", F.lit(None)).when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))


def resolved(ends: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``key, found`` of ends (key, name, file): ``file#name``, a name in a file, an exact name, a part of one, a path.

    Equi-joins in that order; parts of names are sought only for ends that nothing else names.
    """
    hash_ = F.col("name").rlike("^.+#.+$")
    split = ends.select("key", F.when(hash_ & F.col("file").isNull(), F.regexp_extract(F.trim("name"), "^(.*)#", 1)).otherwise(F.col("file")).alias("file"), F.nullif(F.when(hash_, F.regexp_extract(F.trim("name"), "#([^#]*)$", 1)).otherwise(F.trim("name")), F.lit("")).alias("name"))
    named = symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"), "qualified_name", "file_path", "exported", "start_line", (F.col("name") != F.col("qualified_name")).alias("plain"))
    scoped = split.where("file is not null and name is not null").join(named.select("name", F.col("file_path").alias("file"), "qualified_name", "exported", "start_line"), ["file", "name"])
    scoped = scoped.groupBy("key").agg(F.min_by("qualified_name", F.struct((-F.col("exported")).alias("e"), "start_line", "qualified_name")).alias("found"))
    file = F.concat("path", F.lit(":file"))
    whole = split.where("file is not null and name is null").join(files.select(F.col("path").alias("file"), "path"), "file").select("key", file.alias("found"))
    free = split.where("file is null and name is not null")
    exact = free.join(named.select("name", "qualified_name"), "name").groupBy("key").agg(F.min_by("qualified_name", F.struct(F.col("qualified_name") != F.col("name"), "qualified_name")).alias("found"))
    rest = free.join(exact, "key", "left_anti")
    parts = rest.join(symbols.select(F.lower("qualified_name").alias("low"), "qualified_name", "exported", F.col("name").alias("n")), F.contains(F.col("low"), F.lower("name")))
    part = parts.groupBy("key").agg(F.min_by("qualified_name", F.struct((-F.col("exported")).alias("e"), "n", "qualified_name")).alias("found"))
    path = rest.join(part, "key", "left_anti").join(files.select(F.col("path").alias("name"), "path"), "name").select("key", file.alias("found"))
    return scoped.union(whole).union(exact).union(part).union(path)


def ingest(traces: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observed edges, channels they need, and traces that name nothing known, with the reason."""
    from ..tables import stored

    kind = F.coalesce("type", F.when(F.col("method").isNotNull() | F.col("path").isNotNull(), "http").when(F.col("channel").isNotNull(), "event").otherwise("edge"))
    rows = stored(traces.withColumn("kind", kind).withColumn("key", F.monotonically_increasing_id()), "traces")
    source = resolved(rows.select("key", F.col("source").alias("name"), F.col("sourceFile").alias("file")), symbols, files).withColumnRenamed("found", "from")
    target = resolved(rows.where("kind = 'edge'").select("key", F.col("target").alias("name"), F.col("targetFile").alias("file")), symbols, files).withColumnRenamed("found", "to")
    json_of = lambda k: F.get_json_object("metadata", f"$.{k}")
    routes = symbols.where("kind = 'route'").select(url_path(json_of("path")).alias("at"), F.upper(F.coalesce(json_of("method"), F.lit("ANY"))).alias("given"), F.col("name").alias("route"), F.col("qualified_name").alias("to"))
    asked = rows.where("kind = 'http'").select("key", url_path(F.coalesce("path", "target")).alias("at"), F.upper(F.coalesce("method", F.lit("ANY"))).alias("wanted"))
    hit = asked.join(routes, "at").where("given = wanted OR given = 'ANY' OR wanted = 'ANY'").groupBy("key").agg(F.min_by("to", F.struct("route", "to")).alias("to"))
    channel = F.nullif(F.regexp_replace(F.trim(F.coalesce("channel", "target")), r"""^["'`]|["'`]$""", ""), F.lit(""))
    heard = rows.where("kind = 'event'").select("key", channel.alias("name")).where("name is not null").select("key", F.concat(F.lit("channel:"), F.col("name")).alias("to"))
    both = rows.join(source, "key", "left").join(target.union(hit).union(heard), "key", "left")
    named = F.regexp_replace(F.upper(F.trim(F.coalesce("edgeType", F.lit("OBSERVED_CALLS")))), "[^A-Z0-9_]+", "_")
    observed = F.when(named.startswith("OBSERVED_"), named).otherwise(F.concat(F.lit("OBSERVED_"), F.coalesce(F.nullif(named, F.lit("")), F.lit("CALLS"))))
    type_ = F.when(F.col("kind") == "http", "OBSERVED_HTTP_CALLS").when(F.col("kind") == "event", F.when(F.col("direction") == "listen", "OBSERVED_LISTENS_ON").otherwise("OBSERVED_EMITS")).otherwise(observed)
    good = both.where("from is not null and to is not null")
    edges = good.select(F.col("from").alias("source"), F.col("to").alias("target"), type_.alias("edge"), weight(F.col("count")).alias("weight")).groupBy("source", "target", F.col("edge").alias("type")).agg(F.max("weight").alias("weight"))
    what = F.create_map(*(F.lit(x) for p in (("http", "route"), ("event", "channel"), ("edge", "symbol")) for x in p))
    bad = both.where("from is null or to is null").select(*traces.columns, F.when(F.col("from").isNull(), "source not found").otherwise(F.concat(what[F.col("kind")], F.lit(" not found"))).alias("reason"))
    new = good.where("kind = 'event'").select(F.col("to").alias("qualified_name")).distinct().join(symbols.select("qualified_name"), "qualified_name", "left_anti")
    return edges, new.select("qualified_name", F.regexp_replace("qualified_name", "^channel:", "").alias("name")), bad


def stream_edges(events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the observed edges of a stream of events under ``path``; ``latest_edges`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        keep = sorted((d for d in os.listdir(path) if d.startswith("batch=")), key=lambda d: int(d[6:]))[:-2] if os.path.isdir(path) else []
        for old in keep:  # the last two are enough: a reader may hold the one before
            import shutil

            shutil.rmtree(f"{path}/{old}", ignore_errors=True)

    return observed_edges(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of the last whole batch under ``path``."""
    last = max((int(d[6:]) for d in os.listdir(path) if d.startswith("batch=") and os.path.exists(f"{path}/{d}/_SUCCESS")))
    return spark.read.parquet(f"{path}/batch={last}")


def stream_index(raw: DataFrame, home: str, checkpoint: str, **options):
    """Start a query that indexes a stream of files (``path, content``): each batch is extracted, and the last version of a path counts."""
    from ..extract.files import extracted
    from ..sources.repository import files_of

    def write(batch: DataFrame, number: int) -> None:
        files = files_of(batch.select("path", "content"), **options)
        files.withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{home}/files/batch={number}")
        extracted(files).withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{home}/found/batch={number}")

    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current_index(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """Files and what was found in them, by the last batch that had a path."""
    files = spark.read.parquet(f"{home}/files")
    newest = files.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("r = 1").drop("r", "batch")
    found = spark.read.parquet(f"{home}/found").withColumn("path", F.coalesce("symbol.file_path", F.regexp_extract("edge.source", "^(.*?):", 1)))
    return newest.drop("seq"), found.join(newest.select("path", "seq"), ["path", "seq"], "left_semi").select("symbol", "edge")


def windowed(events: DataFrame, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n``: events by window, late ones within the watermark (an extension for streams of events)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
