"""Graph operators over ``symbols`` and ``edges``; all are lazy but the walks, whose rounds are stored tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Frontier nodes (short strings) up to which a walk's step sends them to the edges instead of dealing the edges.
BROADCAST_NODES = 100_000
#: Edge types by trace mode; None is all.
MODES = {
    "calls": ("CALLS", "CALLS_LOCAL"), "data_flow": ("CALLS", "CALLS_LOCAL", "DATA_FLOWS"),
    "cross_service": ("HTTP_CALLS", "CALLS_HTTP_ENDPOINT", "EMITS", "LISTENS_ON", "OBSERVED_HTTP_CALLS", "OBSERVED_EMITS", "OBSERVED_LISTENS_ON"), "all": None,
}
#: Names that something outside calls.
CALLED_FROM_OUTSIDE = ("main", "handler", "setup", "init")


def clamp(value, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError, OverflowError):
        return low


def one_of(column: str, values: list[str]) -> Column:
    return F.lower(F.col(column)).isin([v.lower() for v in values])


def is_test_path(path: Column) -> Column:
    """Whether a folder or file on the way is named for tests, specs, fixtures or mocks."""
    part = F.exists(F.split(F.lower(path), "/"), lambda p: p.rlike(r"(test|tests|spec|specs|fixture|fixtures|mock|mocks)$|^(__tests__|__mocks__)$"))
    return part | F.lower(path).rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")


def cluster_of(path: Column) -> Column:
    """The part of a repository that a path belongs to."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    two = F.array_join(F.slice(parts, 1, 2), "/")
    first = F.try_element_at(parts, F.lit(1))
    return F.when(F.size(parts) == 0, ".").when(first.isin("apps", "packages", "services", "src") & (F.size(parts) > 1), two).otherwise(first)


def matched(symbols: DataFrame, edges: DataFrame, edge_type: str | None = "CALLS", how: str = "inner") -> DataFrame:
    """(a)-[r]->(b): each edge with both ends' columns as a_*, b_*; edges to unknown symbols drop unless ``how`` is left."""
    side = lambda p: symbols.select(*(F.col(c).alias(f"{p}_{c}") for c in symbols.columns))
    r = edges.where(F.col("type") == edge_type) if edge_type else edges
    return r.join(side("a"), r["source"] == F.col("a_qualified_name"), how).join(side("b"), r["target"] == F.col("b_qualified_name"), how)


def degrees(edges: DataFrame) -> DataFrame:
    """``qualified_name, in_degree, out_degree, degree``: one pass over the edges, map-side combined."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("q"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("q"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.q").alias("qualified_name")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def search_graph(
    symbols: DataFrame, edges: DataFrame, *, text: str | None = None, pattern: str | None = None, kind: str | None = None, file: str | None = None,
    relationship: str | None = None, min_degree: int = 0, limit: int = 20, offset: int = 0, window: int | None = None,
) -> DataFrame:
    """Symbols with degrees, filtered; by degree, exported first, name.

    ``text`` is part of name, qualified name, path or signature; ``pattern`` (``*`` and ``?``) fits name or qualified name whole.
    ``window``: a pattern looks at that many rows of the order only (None: all).
    """
    like = lambda v: "%" + v.lower().replace("\\", "\\\\") + "%"
    found = symbols
    if text:
        columns = [c for c in ("name", "qualified_name", "file_path", "signature") if c in symbols.columns]
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).like(like(text)), F.lit(False))
        found = found.where(hit)
    if kind:
        found = found.where(one_of("kind", [kind]))
    if file:
        found = found.where(F.lower("file_path").like(like(file)))
    if relationship:
        typed = edges.where(F.col("type") == relationship.upper())
        touched = typed.select(F.col("source").alias("qualified_name")).union(typed.select("target")).distinct()
        found = found.join(touched, "qualified_name", "left_semi")
    ranked = found.join(degrees(edges), "qualified_name", "left").fillna(0, ["in_degree", "out_degree", "degree"]).where(F.col("degree") >= min_degree)
    order = (F.desc("degree"), F.desc("exported"), "name", "qualified_name")
    if pattern:
        glob = pattern[:160].lower()
        shape = "(?s)" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob) if set(glob) & {"*", "?"} else "(?s).*" + re.escape(glob) + ".*"
        ranked = ranked.orderBy(*order).limit(window) if window else ranked
        ranked = ranked.where(F.lower("name").rlike(f"^{shape}$") | F.lower("qualified_name").rlike(f"^{shape}$"))
    out = ranked.orderBy(*order).select("qualified_name", "name", "kind", "in_degree", "out_degree", "degree")
    return out.offset(max(0, offset)).limit(clamp(limit, 1, 200))


def dead_code(symbols: DataFrame, edges: DataFrame, *, limit: int = 50) -> DataFrame:
    """Functions and methods that are neither exported nor called, with the calls they make; not tests, nor names called from outside."""
    calls = edges.where(F.col("type").isin("CALLS", "CALLS_LOCAL"))
    called, calling = calls.select(F.col("target").alias("qualified_name")), calls.groupBy(F.col("source").alias("qualified_name")).agg(F.count("*").alias("outbound"))
    rows = symbols.where(F.col("kind").isin("function", "method") & (F.col("exported") == 0) & ~F.lower("file_path").rlike("test|spec") & ~F.lower("name").isin(*CALLED_FROM_OUTSIDE))
    out = rows.join(called, "qualified_name", "left_anti").join(calling, "qualified_name", "left").fillna(0, ["outbound"])
    return out.select("qualified_name", "name", "kind", "file_path", "start_line", "outbound").orderBy("file_path", "start_line", "qualified_name").limit(clamp(limit, 1, 500))


def trace(
    edges: DataFrame, start: str, *, symbols: DataFrame | None = None, depth: int = 2, direction: str = "outbound", mode: str = "all", types: list[str] | None = None,
    include_tests: bool = True, parameter: str | None = None, fan_out: int = 100,
) -> DataFrame:
    """``source, target, type, weight, level``: edges reached from ``start``, each once, breadth first.

    A node shows its ``fan_out`` heaviest edges of the wanted types; what the other filters reject is not walked on.
    With ``symbols``, ``start`` is a name or a qualified name, and an unknown one gives no rows.
    """
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError("direction is inbound, outbound or both")
    spark = edges.sparkSession
    wanted = types or MODES[mode]
    kept = edges.where(F.col("type").isin(*wanted)) if wanted else edges
    if symbols is not None:
        from .retrieval import symbol_exact

        row = symbol_exact(symbols, start).first()
        start = row["qualified_name"] if row else None
    columns = ["source", "target", "type", "weight", *(["mappings"] if "mappings" in edges.columns else [])]
    ways = [(n, f) for w, n, f in (("outbound", "source", "target"), ("inbound", "target", "source")) if direction in (w, "both")]
    passes = F.lit(True)
    if not include_tests:
        end = lambda c: F.when(F.instr(c, ":") > 1, F.regexp_replace(c, r":[^:]*$", "")).otherwise(F.col(c))
        passes = passes & ~is_test_path(end("source")) & ~is_test_path(end("target"))
    if parameter:
        said = F.exists("mappings", lambda m: (m["parameter"] == parameter) | (m["argument"] == parameter)) if "mappings" in columns else F.lit(False)
        passes = passes & (F.col("type") == "DATA_FLOWS") & F.coalesce(said, F.lit(False))
    frontier = spark.createDataFrame([(start,)] if start else [], "node string")
    seen, out = frontier, None
    for level in range(1, max(1, depth) + 1):
        here = F.broadcast(frontier) if frontier.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else frontier
        step = None
        for near, far in ways:
            one = kept.select(*columns, F.col(near).alias("node"), F.col(far).alias("far")).join(here, "node", "left_semi")
            step = one if step is None else step.unionByName(one)
        # the frontier's edges alone are ranked
        heaviest = Window.partitionBy("node").orderBy(F.desc("weight"), "far", "type")
        step = step.withColumn("r", F.row_number().over(heaviest)).where((F.col("r") <= fan_out) & passes)
        step = stored(step.select("source", "target", "type", "weight", "far", F.lit(level).alias("level")), "trace")
        out = step if out is None else out.unionByName(step)
        if level < depth:
            frontier = stored(step.select(F.col("far").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
            seen = seen.union(frontier)
    return out.groupBy("source", "target", "type", "weight").agg(F.min("level").alias("level"))


def seeds_of(symbols: DataFrame, items: DataFrame) -> DataFrame:
    """``qualified_name`` of the symbols of each item that is a path; other items (column ``item``) are symbols themselves."""
    of_files = items.join(symbols.select(F.col("file_path").alias("item"), "qualified_name"), "item")
    others = items.join(symbols.select(F.col("file_path").alias("item")), "item", "left_anti")
    return of_files.select("qualified_name").union(others.select("item")).distinct()


def impact(edges: DataFrame, seeds: DataFrame, *, limit: int = 50) -> DataFrame:
    """``neighbor, score, reason``: neighbours of ``seeds`` (qualified_name) by summed weight over both directions, with the heaviest edge as the reason."""
    ends = lambda a, b, word: edges.select(F.col(a).alias("qualified_name"), F.col(b).alias("neighbor"), "weight", F.concat("type", F.lit(f" {word} "), F.col(a)).alias("reason"))
    both = ends("source", "target", "from").unionByName(ends("target", "source", "to").where("qualified_name <> neighbor"))
    hit = both.join(seeds.select("qualified_name").distinct(), "qualified_name", "left_semi")
    rows = hit.groupBy("neighbor").agg(F.sum("weight").alias("score"), F.max(F.struct("weight", "reason")).alias("m"))
    return rows.select("neighbor", "score", F.col("m.reason").alias("reason")).orderBy(F.desc("score"), "neighbor").limit(limit)


# --- components ------------------------------------------------------------------------------------


def _reached(links: DataFrame, seeds: DataFrame, label: str) -> DataFrame:
    """``node, color``: nodes that a seed of the same color reaches over ``links`` (color, source, target)."""
    reached, front = seeds, seeds
    while True:
        new = links.join(front.withColumnRenamed("node", "source"), ["source", "color"]).select(F.col("target").alias("node"), "color").distinct()
        front = stored(new.join(reached, ["node", "color"], "left_anti"), label)
        if front.isEmpty():
            return reached
        reached = stored(reached.union(front), label)


def components(links: DataFrame) -> DataFrame:
    """``member, component``: strongly connected components of more than one node, named by the least member.

    Colouring: the least node that reaches a node is its color; what the color's own node is reached from, inside the color,
    is one component.  Rounds go on without the nodes that are settled.
    """
    rest = stored(links.select("source", "target").where("source <> target").distinct(), "links")
    out = None
    while True:
        # nodes without a way in or out are alone
        while True:
            kept = rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
            kept = stored(kept.select("source", "target"), "links")
            if kept.count() == rest.count():
                break
            rest = kept
        if rest.isEmpty():
            break
        color = stored(rest.select(F.col("source").alias("node")).union(rest.select("target")).distinct().withColumn("color", F.col("node")), "colors")
        while True:
            came = rest.join(color.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("color").alias("came"))
            new = stored(color.join(came, "node", "left").select("node", F.least("color", "came").alias("color"), (F.col("came") < F.col("color")).alias("moved")), "colors")
            color = new.select("node", "color")
            if new.where("moved").isEmpty():
                break
        inside = rest.join(color.withColumnRenamed("node", "source"), "source").join(color.select(F.col("node").alias("target"), F.col("color").alias("far")), "target").where("color = far")
        back = stored(inside.select("color", F.col("target").alias("source"), F.col("source").alias("target")), "backward")
        found = _reached(back, stored(color.where("node = color"), "seeds"), "reached")
        out = found if out is None else out.union(found)
        gone = found.select("node")
        rest = stored(rest.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"), "links")
    if out is None:
        return links.select(F.col("source").alias("member"), F.col("source").alias("component")).limit(0)
    several = out.groupBy("color").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return out.join(several, "color").select(F.col("node").alias("member"), "component")


def cluster_links(symbols: DataFrame, edges: DataFrame, edge_type: str = "IMPORTS_FILE") -> DataFrame:
    """``source, target, edges, samples``: edges between parts of the repository, with the first three of each pair."""
    rows = matched(symbols, edges, edge_type).select(cluster_of(F.col("a_file_path")).alias("from"), cluster_of(F.col("b_file_path")).alias("to"), "source", "target", "type").where("from <> to")
    first = Window.partitionBy("from", "to").orderBy("source", "target")
    numbered = rows.withColumn("r", F.row_number().over(first))
    sample = F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("source", "target", "type"))))
    return numbered.groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count("*").alias("edges"), sample.alias("samples"))


def cycles(links: DataFrame, *, limit: int = 20) -> DataFrame:
    """``component, members, edges, samples`` of the cycles among ``links`` (source, target, edges, samples), most edges first."""
    parts = stored(components(links), "cycles")
    a, b = parts.select(F.col("member").alias("source"), "component"), parts.select(F.col("member").alias("target"), F.col("component").alias("other"))
    inside = links.join(a, "source").join(b, "target").where("component = other").groupBy("component").agg(F.sum("edges").alias("edges"), F.slice(F.flatten(F.sort_array(F.collect_list("samples"))), 1, 8).alias("samples"))
    named = parts.groupBy("component").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return named.join(inside, "component").orderBy(F.desc("edges"), "component").limit(clamp(limit, 1, 100))
