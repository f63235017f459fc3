"""Retrieval over lines and symbols: an index that is built once, ranked and exact search, references, snippets, context."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from . import graph as G
from . import terms as T

K1, B = 1.2, 0.75
NOT_SEMANTIC = ("file", "dependency", "package")
NOT_VECTORS = (*NOT_SEMANTIC, "lockfile", "locked_dependency")


def clamp(value, low: int, high: int) -> int:
    """``value`` as a whole number between two bounds; the lower one for what is no number."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError, OverflowError):
        return low


def like_part(text: str) -> str:
    """``text`` inside a LIKE pattern; its own _ and % stay wildcards."""
    return "%" + text.lower().replace("\\", "\\\\") + "%"


# --- ranked search over lines ----------------------------------------------------------------------


def tokenized(lines: DataFrame) -> DataFrame:
    """``path, line, tokens`` of ``path, line, text``: what the index and its totals are made from, best stored."""
    return lines.select("path", "line", T.index_tokens(F.col("text")).alias("tokens"))


def line_index(tokens: DataFrame) -> DataFrame:
    """``path, line, length, token, tf``: the inverted index of ``tokenized`` lines; store it sorted by token and searches read few of its rows."""
    each = tokens.select("path", "line", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    return each.groupBy("path", "line", "length", "token").agg(F.count("*").alias("tf"))


def index_totals(tokens: DataFrame) -> DataFrame:
    """``n, average``: lines and their mean number of tokens, one row."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("average"))


def search_index(index: DataFrame, totals: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """``path, line, score`` of the best lines; every term of the query is a prefix, any of them counts."""
    wanted = T.query_terms(query)
    if not wanted:
        return index.select("path", "line", F.lit(0.0).alias("score")).limit(0)
    starts = F.array(*(F.when(F.col("token").startswith(t), F.lit(t)) for t in wanted))
    rows = index.where(" OR ".join(f"token LIKE '{t}%'" for t in wanted)).withColumn("term", F.explode(F.array_compact(starts)))
    per = rows.groupBy("path", "line", "length", "term").agg(F.sum("tf").alias("tf"))
    return _best_lines(per, per.groupBy("term").agg(F.count("*").alias("df")), totals, limit)


def _best_lines(per: DataFrame, found: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    """The best of ``path, line, length, term, tf`` by BM25."""
    both = per.join(F.broadcast(found), "term").join(F.broadcast(totals))  # at most 12 terms; one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.000001))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = both.groupBy("path", "line").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "path", "line").limit(clamp(limit, 1, 500))


def search_lines(lines: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """As ``search_index``, without an index: one pass over ``path, line, text`` stores each line's length and its counts of the query's terms, no token is ever a row. For one query this is less than an index, which holds several times the text."""
    wanted = T.query_terms(query)
    if not wanted:
        return lines.select("path", "line", F.lit(0.0).alias("score")).limit(0)
    counts = stored(T.measured(lines.select("path", "line", "text"), "text", wanted), "line-counts")
    totals = counts.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    hit = counts.where(" OR ".join(f"tf{k} > 0" for k in range(len(wanted))))
    pairs = hit.select("path", "line", "length", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"tf{k}").alias("tf")) for k, t in enumerate(wanted)))).alias("of"))
    per = pairs.select("path", "line", "length", "of.term", "of.tf").where("tf > 0").groupBy("path", "line", "length", "term").agg(F.sum("tf").alias("tf"))
    per = stored(per, "line-terms")  # read for the documents of each term and for the scores
    return _best_lines(per, per.groupBy("term").agg(F.count("*").alias("df")), totals, limit)


def substring_search(lines: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """``path, line, score``: 1 where the text stands as it is, 0.5 where only its letters agree."""
    hit = lines.where(F.lower("text").like(like_part(query)))
    return hit.select("path", "line", F.when(F.contains("text", F.lit(query)), 1.0).otherwise(0.5).alias("score")).orderBy("path", "line").limit(clamp(limit, 1, 500))


def search_code(lines: DataFrame, index: DataFrame | None, totals: DataFrame | None, query: str, *, limit: int = 20) -> DataFrame:
    """Ranked search, without an index if there is none; by substring if that finds nothing."""
    found = search_lines(lines, query, limit=limit) if index is None else search_index(index, totals, query, limit=limit)
    return substring_search(lines, query, limit=limit) if found.isEmpty() else found


# --- symbols and places ----------------------------------------------------------------------------


def symbol_search(symbols: DataFrame, query: str, *, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols by a part of the name (with ``kind``) or the qualified name; exported first, then by name."""
    part = like_part(query)
    if kind:
        found = symbols.where(F.lower("name").like(part) & (F.lower("kind") == kind.lower()))
    else:
        found = symbols.where(F.lower("name").like(part) | F.lower("qualified_name").like(part))
    return found.orderBy(F.desc("exported"), "name", "qualified_name").limit(clamp(limit, 1, 500))


def symbol_exact(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol of that name; a qualified name comes before a plain one."""
    hit = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    return hit.orderBy((F.col("qualified_name") == name).desc(), "qualified_name").limit(1)


def identifier(text: Column, name: str) -> Column:
    """Whether ``name`` stands in ``text`` as an identifier of its own; part of it for names that are none."""
    if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", name):
        return F.contains(F.lower(text), F.lit(name.lower()))
    return F.contains(text, F.lit(name)) & text.rlike(rf"(^|[^A-Za-z0-9_$]){re.escape(name)}([^A-Za-z0-9_$]|$)")


def references(symbols: DataFrame, lines: DataFrame, name: str, *, limit: int = 100) -> DataFrame:
    """``path, line, kind, score``: the first line in the symbol's own range defines it, its file's other lines come next."""
    row = symbol_exact(symbols, name).first() or symbol_search(symbols, name, limit=1).first()
    own = lines.where(identifier(F.col("text"), row["name"] if row else name))
    if not row:
        told = own.select("path", "line", F.lit("reference").alias("kind"), F.lit(0.7).alias("score"))
    else:
        here = F.col("path") == row["file_path"]
        inside = here & F.col("line").between(row["start_line"], row["end_line"])
        first = F.row_number().over(Window.partitionBy("path", "inside").orderBy("line")) == 1
        marked = own.withColumn("inside", inside).withColumn("defines", F.col("inside") & first)
        told = marked.select("path", "line", F.when(F.col("defines"), "definition").otherwise("reference").alias("kind"), F.when(F.col("defines"), 1.0).when(here, 0.82).otherwise(0.7).alias("score"))
    return told.orderBy(F.desc("score"), "path", "line").limit(clamp(limit, 1, 500))


def snippet(symbols: DataFrame, files: DataFrame, name: str, *, context: int = 4) -> DataFrame:
    """``path, line, text, highlight`` around a symbol, a ``path:line``, or the first 40 lines of a path; blank lines included."""
    around = clamp(context, 0, 40)
    row, place = symbol_exact(symbols, name).first(), re.fullmatch(r"(.+):(\d+)", name)
    if row:
        path, first, last = row["file_path"], row["start_line"], row["end_line"]
    elif place:
        path, first, last = place[1], int(place[2]), int(place[2])
    else:
        path, first, last, around = name, 1, 40, 0
    rows = files.where(F.col("path") == path).select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "text"))
    line = F.col("at") + 1
    return rows.where(line.between(max(1, first - around), last + around)).select("path", line.alias("line"), "text", line.between(first, last).alias("highlight")).orderBy("line")


def windows(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbols`` with ``body``: the lines between their bounds, by one join on the path; texts are dealt, as their estimated size may be far too small to send them to all."""
    texts = files.select(F.col("path").alias("file_path"), F.split("text", r"\r?\n", -1).alias("_lines")).hint("merge")
    length = F.greatest(F.col("end_line"), F.col("start_line")) - F.col("start_line") + 1
    body = F.array_join(F.slice("_lines", F.greatest("start_line", F.lit(1)), length), "\n")
    return symbols.join(texts, "file_path", "left").withColumn("body", F.coalesce(body, F.lit(""))).drop("_lines")


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """``places`` (path, line) with ``owner``: the smallest function, method, class or route around the line, or the file."""
    numbered = places.withColumn("_place", F.monotonically_increasing_id())
    s = symbols.where(F.col("kind").isin("function", "method", "class", "route")).select(F.col("file_path").alias("path"), "start_line", "end_line", F.col("qualified_name").alias("owner"))
    inside = numbered.join(s, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    smallest = inside.groupBy("_place").agg(F.min_by("owner", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "owner")).alias("owner"))
    return numbered.join(smallest, "_place", "left").withColumn("owner", F.coalesce("owner", F.concat("path", F.lit(":file")))).drop("_place")


# --- tokens and vectors ----------------------------------------------------------------------------


def _tokens_of(spark, query: str) -> list[str]:
    """Semantic tokens of the query, in order, with repeats (one row, by the same expression that reads the corpus)."""
    return spark.range(1).select(T.semantic_tokens(F.lit(query)).alias("t")).first()["t"]


def _hits(column: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(column, F.array(*map(F.lit, wanted))))


def _in_path(wanted: list[str]) -> Column:
    return sum((F.when(F.contains(F.lower("file_path"), F.lit(t)), 1).otherwise(0) for t in wanted), F.lit(0))


def _best_symbols(scored: DataFrame, limit: int) -> DataFrame:
    """The best of ``qualified_name, score``, where null is no score. Scores are judged after the order: a condition on them would be pushed to the texts and evaluate them once more for each use."""
    best = scored.orderBy(F.desc_nulls_last("score"), "qualified_name").limit(clamp(limit, 1, 100))
    return best.where("score IS NOT NULL")


def semantic_search(symbols: DataFrame, files: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """``qualified_name, score``: shared tokens, more for those in name and path; exported symbols always score a little."""
    return _semantic_search(windows(symbols.where(~F.col("kind").isin(*NOT_SEMANTIC)), files), query, limit)


def _semantic_search(rows: DataFrame, query: str, limit: int) -> DataFrame:
    wanted = list(dict.fromkeys(_tokens_of(rows.sparkSession, query)))
    if not wanted:
        return rows.select("qualified_name", F.lit(0.0).alias("score")).limit(0)
    tokens = F.array_distinct(T.semantic_tokens(F.concat_ws("\n", "name", F.coalesce("signature", F.lit("")), "file_path", "body")))
    measured = rows.select("qualified_name", "name", "file_path", "exported", tokens.alias("tokens"))
    hits, size = _hits(F.col("tokens"), wanted), F.greatest(F.size("tokens"), F.lit(1))
    base = F.when(hits == 0, 0.0).otherwise(F.round(hits / len(wanted) * 0.7 + hits / F.sqrt(size) * 0.3, 4))
    boost = _hits(F.array_distinct(T.semantic_tokens(F.col("name"))), wanted) * 0.18 + _in_path(wanted) * 0.08 + F.when(F.col("exported") == 1, 0.03).otherwise(0.0)
    scored = measured.select("qualified_name", F.round(F.least(F.lit(1.0), base + boost), 4).alias("score"))
    return _best_symbols(scored.select("qualified_name", F.when(F.col("score") > 0, F.col("score")).alias("score")), limit)


def vector_index(symbols: DataFrame, files: DataFrame, *, dimensions: int = T.DIMENSIONS) -> DataFrame:
    """``qualified_name, name, file_path, exported, tokens, weights, magnitude`` of symbols whose text has any token."""
    return _vector_index(windows(symbols.where(~F.col("kind").isin(*NOT_VECTORS)), files), dimensions)


def _vector_index(rows: DataFrame, dimensions: int = T.DIMENSIONS) -> DataFrame:
    text = F.concat_ws("\n", "kind", "name", "qualified_name", "file_path", F.coalesce("signature", F.lit("")), F.lit(""), F.coalesce("metadata", F.lit("{}")), "body")
    told = rows.select("qualified_name", "name", "file_path", "exported", T.semantic_tokens(text).alias("all"))
    return T.hashed_vectors(told, "qualified_name", "all", dimensions)


def hashed_search(index: DataFrame, query: str, *, limit: int = 20, dimensions: int = T.DIMENSIONS) -> DataFrame:
    """``qualified_name, score``: cosine of hashed vectors, a little more for hits in name and path and for exported symbols."""
    every = _tokens_of(index.sparkSession, query)
    wanted = list(dict.fromkeys(every))
    if not wanted:
        return index.select("qualified_name", F.lit(0.0).alias("score")).limit(0)
    _, weights, magnitude = (c[0].as_py() for c in T.vectors(pa.array([every], pa.list_(pa.string())), np.zeros(1, np.int64), dimensions))
    if not magnitude:
        return index.select("qualified_name", F.lit(0.0).alias("score")).limit(0)  # its tokens cancel out
    of = F.create_map(*(F.lit(y) for x in weights for y in (x["bucket"], x["weight"])))
    dot = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.try_element_at(of, x["bucket"]), F.lit(0.0)))
    boost = _hits(F.array_distinct(T.semantic_tokens(F.col("name"))), wanted) * 0.03 + _in_path(wanted) * 0.015 + F.when(F.col("exported") == 1, 0.01).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / (F.col("magnitude") * F.lit(magnitude)) + boost)), 4)
    rows = index.select("qualified_name", score.alias("score"), _hits(F.col("tokens"), wanted).alias("hits"))
    return _best_symbols(rows.select("qualified_name", F.expr("CASE WHEN score > 0.04 AND (hits > 0 OR score > 0.2) THEN score END").alias("score")), limit)


def context_pack(symbols: DataFrame, edges: DataFrame, files: DataFrame, lines: DataFrame, query: str, *, limit: int = 6) -> DataFrame:
    """``section, rank, qualified_name, path, line, score``: what every search finds, the symbols in order of first mention, and edges at the first five."""
    n = clamp(limit, 1, 20)
    ranked = lambda df, name, order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("section", F.lit(name))  # noqa: E731 - at most 20 rows
    null = F.lit(None)
    found = []
    bodies = stored(windows(symbols.where(~F.col("kind").isin(*NOT_SEMANTIC)), files), "bodies")  # of both searches
    index = _vector_index(bodies.where(~F.col("kind").isin(*NOT_VECTORS)))
    for name, df in (("semantic", _semantic_search(bodies, query, n)), ("vector", hashed_search(index, query, limit=n)), ("graph", G.search_graph(symbols, edges, text=query, limit=n).withColumn("score", F.col("degree").cast("double")))):
        df = stored(df, name)  # a few rows that are read more than once
        found.append(ranked(df, name, (F.desc("score"), "qualified_name")).select("section", "rank", "qualified_name", null.cast("string").alias("path"), null.cast("int").alias("line"), "score"))
    code = ranked(search_lines(lines, query, limit=n), "code", (F.desc("score"), "path", "line")).select("section", "rank", null.cast("string").alias("qualified_name"), "path", "line", "score")
    every = found[0].unionByName(found[1]).unionByName(found[2])
    order = F.create_map(*(F.lit(x) for p in (("semantic", 0), ("vector", 1), ("graph", 2)) for x in p))
    first = every.groupBy("qualified_name").agg(F.min(F.struct(order[F.col("section")].alias("s"), "rank")).alias("at"))
    picked = first.withColumn("n", F.row_number().over(Window.orderBy("at", "qualified_name"))).where(F.col("n") <= n)
    snippets = picked.join(symbols.select("qualified_name", "file_path", "start_line"), "qualified_name").select(F.lit("snippet").alias("section"), F.col("n").alias("rank"), "qualified_name", F.col("file_path").alias("path"), F.col("start_line").alias("line"), null.cast("double").alias("score"))
    five = picked.where("n <= 5").select("qualified_name")
    near = edges.join(five.withColumnRenamed("qualified_name", "source"), "source", "left_semi").union(edges.join(five.withColumnRenamed("qualified_name", "target"), "target", "left_semi").select(*edges.columns)).distinct()
    told = ranked(near.orderBy(F.desc("weight"), "source", "target", "type").limit(50), "edge", (F.desc("weight"), "source", "target", "type"))
    links = told.select("section", "rank", F.col("source").alias("qualified_name"), F.col("target").alias("path"), null.cast("int").alias("line"), F.col("weight").alias("score"))
    return every.unionByName(code).unionByName(snippets).unionByName(links)
