"""Several repositories at once: every table has a ``project`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import clamp

GROUPS = ("project", "route", "dependency", "language")
EDGE_ORDER = ("CROSS_REPO_HTTP_CALLS", "ROUTE_OVERLAP", "SHARES_DEPENDENCY", "PROVIDES_ROUTE", "CALLS_ENDPOINT", "DEPENDS_ON", "USES_LANGUAGE")


def endpoint(method: Column, path: Column) -> Column:
    word = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return F.concat(F.upper(word(method, "ANY")), F.lit(" "), word(path, "/"))


def fleet_languages(languages: DataFrame) -> DataFrame:
    """``language, files, symbols, projects`` from ``project, language, files, symbols``."""
    return languages.groupBy("language").agg(F.sum("files").alias("files"), F.sum("symbols").alias("symbols"), F.countDistinct("project").alias("projects")).orderBy(F.desc("symbols"), "language")


def shared(rows: DataFrame, column: str, *, limit: int = 50) -> DataFrame:
    """Values of a column that two projects or more have: how many, and which (``project`` rows may repeat)."""
    names = F.array_join(F.sort_array(F.collect_set("project")), ",")
    out = rows.groupBy(column).agg(F.countDistinct("project").alias("n"), names.alias("projects")).where("n >= 2")
    return out.orderBy(F.desc("n"), column).limit(clamp(limit, 1, 500))


def bare_host(host: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")
    return F.when(low.rlike(r"^\[[^\]]+\](:[0-9]+)?$"), F.regexp_extract(low, r"^\[([^\]]+)\]", 1)).otherwise(F.regexp_replace(low, ":[0-9]+$", ""))


def is_service_host(host: Column) -> Column:
    bare = bare_host(host)
    return F.coalesce((bare != "") & ~bare.isin("localhost", "0.0.0.0", "::1", "host.docker.internal") & ~bare.startswith("127."), F.lit(False))


def aliases(value: Column) -> Column:
    """Names that a service may go by: whole, last part, first label, and without a suffix of its trade."""
    clean = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(v), r"^@[^/]+/", ""), r"[_\s]+", "-"), r"[^a-z0-9.-]+", "-"), "-+", "-"), r"^[.-]+|[.-]+$", "")
    short = lambda v: F.regexp_replace(v, r"-(api|service|server|backend|app)$", "")
    last = F.element_at(F.filter(F.split(F.trim(value), "[/:]"), lambda p: p != ""), -1)
    names = F.array(clean(F.trim(value)), clean(last))
    labels = F.transform(names, lambda n: F.element_at(F.split(n, r"\."), 1))
    return F.array_distinct(F.filter(F.concat(names, labels, F.transform(names, short), F.transform(labels, short)), lambda n: n.isNotNull() & (n != "")))


def service_links(routes: DataFrame, calls: DataFrame, names: DataFrame, *, limit: int | None = 100) -> DataFrame:
    """``consumer, provider, route, host, confidence, reason, calls``: endpoints (project, endpoint) that calls (project, endpoint, method, host) of other projects name.

    ``names`` (project, name) are what a project is called.  Calls to a host of the provider count as that; calls to other hosts
    alone are no link; calls without a host are sure only when one other project provides the endpoint.
    """
    own = names.select("project", F.explode(aliases(F.col("name"))).alias("alias")).distinct()
    given = routes.select(F.col("project").alias("provider"), "endpoint").distinct()
    asked = calls.withColumn("service", is_service_host(F.col("host"))).withColumn("any", F.upper(F.coalesce("method", F.lit("ANY"))) == "ANY")
    per = asked.groupBy(F.col("project").alias("consumer"), "endpoint").agg(F.count_if(~F.col("service")).alias("relative"), F.count_if("service").alias("hosted"), F.max("any").alias("any"))
    pairs = per.join(given, "endpoint")
    others = F.count_if(F.col("provider") != F.col("consumer")).over(Window.partitionBy("consumer", "endpoint"))
    pairs = pairs.withColumn("others", others).where("consumer <> provider")
    hosts = asked.where("service").groupBy(F.col("project").alias("consumer"), "endpoint", "host").agg(F.count("*").alias("n")).select("consumer", "endpoint", "host", "n", F.explode(aliases(bare_host(F.col("host")))).alias("alias"))
    met = hosts.join(own.withColumnRenamed("project", "provider"), "alias").select("consumer", "endpoint", "provider", "host", "n").distinct().groupBy("consumer", "endpoint", "provider").agg(F.sum("n").alias("matched"), F.min("host").alias("host"))
    rows = pairs.join(met, ["consumer", "endpoint", "provider"], "left").where("matched IS NOT NULL OR relative > 0")
    any_ = F.col("any") | F.col("endpoint").startswith("ANY ")
    by_host = F.col("matched").isNotNull()
    confidence = F.when(by_host, 0.95).when(F.col("others") > 1, 0.45).when(any_, 0.65).otherwise(0.85)
    reason = F.when(by_host, "method_path_host").otherwise(F.concat(F.when(any_, "any_path").otherwise("method_path"), F.when(F.col("others") > 1, "_ambiguous").otherwise("_unique")))
    out = rows.select("consumer", "provider", F.col("endpoint").alias("route"), "host", confidence.alias("confidence"), reason.alias("reason"), F.coalesce("matched", "relative").alias("calls"))
    out = out.orderBy(F.desc("confidence"), F.desc("calls"), "consumer", "provider", "route")
    return out.limit(limit) if limit else out


def fleet_graph(languages: DataFrame, dependencies: DataFrame, routes: DataFrame, calls: DataFrame, links: DataFrame, *, max_nodes: int = 500, max_edges: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, node_group) and edges (source, target, type, weight) between projects and what they use, provide and share."""
    project = lambda c: F.concat(F.lit("project:"), F.col(c))
    one = F.lit(1.0)
    deps = shared(dependencies, "name", limit=500).select("name", F.explode(F.split("projects", ",")).alias("project"), "n")
    both = shared(routes.select("project", "endpoint"), "endpoint", limit=500).select("endpoint", F.explode(F.split("projects", ",")).alias("project"), "n")
    shape = lambda df, target, type_, weight: df.select(project("project").alias("source"), target.alias("target"), F.lit(type_).alias("type"), weight.cast("double").alias("weight"))
    at = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c))
    edges = [
        shape(languages, at("language", "language"), "USES_LANGUAGE", F.greatest(F.lit(1), "symbols")), shape(dependencies, at("dependency", "name"), "DEPENDS_ON", one), shape(routes, at("route", "endpoint"), "PROVIDES_ROUTE", one),
        shape(calls, at("route", "endpoint"), "CALLS_ENDPOINT", one), shape(deps, at("dependency", "name"), "SHARES_DEPENDENCY", F.col("n")), shape(both, at("route", "endpoint"), "ROUTE_OVERLAP", F.col("n")),
        links.select(project("consumer").alias("source"), project("provider").alias("target"), F.lit("CROSS_REPO_HTTP_CALLS").alias("type"), F.greatest(F.lit(1), "calls").cast("double").alias("weight")),
    ]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    every = every.distinct()
    ids = every.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    group = F.regexp_extract("id", "^([a-z]+):", 1)
    order = F.array_position(F.array(*map(F.lit, GROUPS)), group)
    nodes = ids.select("id", F.regexp_replace("id", "^[a-z]+:", "").alias("label"), group.alias("node_group"), order.alias("o")).orderBy("o", "label", "id").limit(clamp(max_nodes, 1, 5000)).drop("o")
    seen = every.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    rank = F.array_position(F.array(*map(F.lit, EDGE_ORDER)), F.col("type"))
    return nodes, seen.select("source", "target", "type", "weight").orderBy(rank, F.desc("weight"), "source", "target").limit(clamp(max_edges, 1, 10000))
