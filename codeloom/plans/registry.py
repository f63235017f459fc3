"""Registered queries of the code-graph operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import graph as G
from ..operators import search as S
from ..operators import vectors as V
from .views import register, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register ``f(spark)``, which finds the tables and graph as views, under ``name`` with its SQL, if it has any."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir)
            return f(spark)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.table("symbols"), spark.table("edges")


_MATCH = "FROM edges r JOIN symbols a ON r.source = a.qualified_name JOIN symbols b ON r.target = b.qualified_name"


@query("cypher_edge_weight", f'SELECT a.name AS "a.name", b.name AS "b.name", r.weight AS "r.weight" {_MATCH} WHERE a.kind = \'function\' AND r.weight >= 2 ORDER BY r.weight DESC, a.name, b.name LIMIT 500')
def cypher_edge_weight(spark):
    return run_cypher(spark, "MATCH (a:Function)-[r:CALLS]->(b) WHERE r.weight >= 2 RETURN a.name, b.name, r.weight ORDER BY r.weight DESC, a.name, b.name LIMIT 500")


@query("cypher_node_filter", "SELECT name AS \"n.name\", start_line AS \"n.startLine\" FROM symbols WHERE kind = 'class' AND start_line > 40 ORDER BY name LIMIT 100")
def cypher_node_filter(spark):
    return run_cypher(spark, "MATCH (n:Class) WHERE n.startLine > 40 RETURN n.name, n.startLine ORDER BY n.name LIMIT 100")


@query("cypher_or_precedence", "SELECT qualified_name AS \"n.qualifiedName\" FROM symbols WHERE kind = 'method' AND start_line = 7 OR name LIKE '%_12' ORDER BY qualified_name LIMIT 200")
def cypher_or_precedence(spark):
    return run_cypher(spark, "MATCH (n) WHERE n.kind = 'method' AND n.startLine = '7' OR n.name ENDS WITH '_12' RETURN n ORDER BY n.qualifiedName LIMIT 200")


@query("cypher_count", f"SELECT count(*) AS calls {_MATCH} WHERE b.exported = 1")
def cypher_count(spark):
    return run_cypher(spark, "MATCH (a)-[r:CALLS]->(b) WHERE b.exported = '1' RETURN count(*) AS calls")


@query("cypher_count_distinct", f"SELECT count(DISTINCT a.name) AS count {_MATCH}")
def cypher_count_distinct(spark):
    return run_cypher(spark, "MATCH (b)<-[r:CALLS]-(a) RETURN count(DISTINCT a.name)")


@query("cypher_distinct_skip", "SELECT DISTINCT kind AS kind FROM symbols ORDER BY kind LIMIT 2 OFFSET 1")
def cypher_distinct_skip(spark):
    return run_cypher(spark, "MATCH (n) RETURN DISTINCT n.kind AS kind ORDER BY n.kind SKIP 1 LIMIT 2")


@query("cypher_in", "SELECT name AS \"n.name\" FROM symbols WHERE kind IN ('class', 'method') AND name LIKE '%_1%' ORDER BY name LIMIT 50")
def cypher_in(spark):
    return run_cypher(spark, "MATCH (n) WHERE n.kind IN ['class', 'METHOD'] AND n.name CONTAINS '_1' RETURN n.name ORDER BY n.name LIMIT 50")


_DEGREES = "SELECT q, sum(i) AS i, sum(o) AS o, count(*) AS d FROM (SELECT source AS q, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges) e GROUP BY q"


@query("graph_search_degree", f"SELECT qualified_name, name, kind, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(d, 0) AS degree FROM symbols LEFT JOIN ({_DEGREES}) x ON q = qualified_name WHERE coalesce(d, 0) >= 2 ORDER BY degree DESC, exported DESC, name LIMIT 50")
def graph_search_degree(spark):
    return G.search_graph(*_graph(spark), min_degree=2, limit=50)


@query("graph_search_relationship", f"SELECT qualified_name, name, kind, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(d, 0) AS degree FROM symbols JOIN ({_DEGREES}) x ON q = qualified_name WHERE kind = 'class' ORDER BY degree DESC, exported DESC, name LIMIT 20")
def graph_search_relationship(spark):
    return G.search_graph(*_graph(spark), kind="class", relationship="calls")


@query("dead_code", """SELECT qualified_name, name, kind, file_path, start_line, coalesce(o, 0) AS outbound FROM symbols LEFT JOIN (SELECT source, count(*) AS o FROM edges WHERE type IN ('CALLS', 'CALLS_LOCAL') GROUP BY source) c ON source = qualified_name
WHERE kind IN ('function', 'method') AND exported = 0 AND qualified_name NOT IN (SELECT target FROM edges WHERE type IN ('CALLS', 'CALLS_LOCAL')) AND lower(name) NOT IN ('main', 'handler', 'setup', 'init')
AND lower(file_path) NOT LIKE '%test%' AND lower(file_path) NOT LIKE '%spec%' ORDER BY file_path, start_line, qualified_name LIMIT 500""")
def dead_code(spark):
    return G.dead_code(*_graph(spark), limit=500)


@query("schema_node_labels", "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def schema_node_labels(spark):
    return A.counts(spark.table("symbols"), "kind")


@query("schema_patterns", f"SELECT a.kind AS source_kind, r.type AS type, b.kind AS target_kind, count(*) AS n {_MATCH} GROUP BY a.kind, r.type, b.kind")
def schema_patterns(spark):
    return A.relationship_patterns(*_graph(spark))


@query("trace_outbound_d2", "SELECT source, target, type, weight, 1 AS level FROM edges WHERE source = 'part:1' UNION ALL SELECT source, target, type, weight, 2 AS level FROM edges WHERE source <> 'part:1' AND source IN (SELECT target FROM edges WHERE source = 'part:1')")
def trace_outbound_d2(spark):
    return G.trace(spark.table("edges"), "part:1", depth=2)


@query("trace_inbound_d1", "SELECT source, target, type, weight, 1 AS level FROM edges WHERE target = 'part:2'")
def trace_inbound_d1(spark):
    return G.trace(spark.table("edges"), "part:2", depth=1, direction="inbound")


@query("impact_files", """SELECT neighbor, sum(weight) AS score, arg_max(reason, {'w': weight, 'r': reason}) AS reason FROM (
SELECT source AS q, target AS neighbor, weight, concat(type, ' from ', source) AS reason FROM edges UNION ALL SELECT target, source, weight, concat(type, ' to ', target) FROM edges) e
WHERE q IN (SELECT qualified_name FROM symbols WHERE start_line = 7) GROUP BY neighbor ORDER BY score DESC, neighbor LIMIT 50""")
def impact_files(spark):
    symbols, edges = _graph(spark)
    return G.impact(edges, G.seeds_of(symbols, symbols.where("start_line = 7").select(F.col("file_path").alias("item"))))


_REACH = "r(source, target) AS (SELECT source, target FROM imports UNION SELECT r.source, i.target FROM r JOIN imports i ON r.target = i.source)"


@query("cycles_scc", f"SELECT member, component FROM (WITH RECURSIVE {_REACH} SELECT x.source AS member, least(min(x.target), x.source) AS component FROM r x JOIN r y ON x.source = y.target AND x.target = y.source WHERE x.source <> x.target GROUP BY x.source) z")
def cycles_scc(spark):
    return G.components(spark.table("imports"))


_LINES = "SELECT path, CAST(i AS INTEGER) AS line, substr(ls[i], 1, 2000) AS text FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split_regex(text, '\\r?\\n') AS ls FROM files) a) b WHERE trim(ls[i]) <> ''"


@query("code_lines", _LINES)
def code_lines(spark):
    return S.code_lines(spark.table("files"))


@query("markers", f"SELECT count(*) AS lines, count(*) FILTER (lower(text) LIKE '%todo%' OR lower(text) LIKE '%fixme%') AS tasks, count(*) FILTER (lower(text) LIKE '%api_key%' OR lower(text) LIKE '%secret%' OR lower(text) LIKE '%password%') AS sensitive FROM ({_LINES}) l")
def markers(spark):
    return A.markers(S.code_lines(spark.table("files")))


_TOKENS = "SELECT path, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM files"
_BM25 = f"""SELECT path, round(sum(score), 6) AS score FROM (
SELECT t.path, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score
FROM (SELECT path, token, count(*) AS tf FROM ({_TOKENS}) k WHERE token IN ('anea', 'station', 'thing') GROUP BY path, token) t
JOIN (SELECT token, count(DISTINCT path) AS df FROM ({_TOKENS}) k GROUP BY token) d USING (token)
JOIN (SELECT path, count(*) AS len FROM ({_TOKENS}) k GROUP BY path) l USING (path)
CROSS JOIN (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT path, count(*) AS len FROM ({_TOKENS}) k GROUP BY path) m) g) s GROUP BY path ORDER BY score DESC, path LIMIT 20"""


@query("bm25_search", _BM25)
def bm25_search(spark):
    return S.bm25(spark.table("files"), ["anea", "station", "thing"], limit=20)


@query("language_files", "SELECT language, count(*) AS files, sum(chars) AS chars, count(DISTINCT project) AS projects FROM files GROUP BY language")
def language_files(spark):
    return spark.table("files").groupBy("language").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.countDistinct("project").alias("projects"))


@query("trace_ingest_edges", "SELECT concat('user:', CAST(user_id AS VARCHAR)) AS source, concat('channel:', event_type) AS target, 'OBSERVED_EMITS' AS type, CAST(least(greatest(count(*), 1), 1000) AS DOUBLE) AS weight FROM events GROUP BY user_id, event_type")
def trace_ingest_edges(spark):
    from ..streaming.traces import observed_edges

    return observed_edges(spark.table("events"))


@query("vector_search", "SELECT vec_id, round(score, 4) AS score FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) s ORDER BY score DESC, vec_id LIMIT 20")
def vector_search(spark):
    return S.nearest_vectors(spark.table("embeddings"), 1, limit=20)


@query("vector_search_all", "SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q) s WHERE isfinite(score)) t WHERE r <= 20")
def vector_search_all(spark):
    return V.nearest_of_each(spark.table("embeddings"), spark.table("embeddings").where("vec_id % 50 = 0"), limit=20)


def run_cypher(spark: SparkSession, text: str) -> DataFrame:
    from .cypher import query_graph

    return query_graph(*_graph(spark), text)


def _more() -> None:
    """Further queries, which use what is defined here."""
    from . import queries  # noqa: F401


_more()
