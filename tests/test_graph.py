import pytest

from codeloom.operators import graph as G
from codeloom.plans import cypher

SYMBOLS = "id long, qualified_name string, name string, kind string, file_path string, language string, exported int, start_line int, end_line int"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(i, f"q{i}", f"n_{i}", "class" if i == 1 else "function", f"src/{i}.ts", "typescript", i % 2, i, i + 5) for i in range(1, 5)]
    edges = [("q1", "q2", "CALLS", 2.0), ("q2", "q3", "CALLS", 1.0), ("q3", "q1", "CALLS", 1.0), ("q3", "external:x", "IMPORTS", 1.0)]
    return spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(edges, "source string, target string, type string, weight double")


def test_cypher_joins_and_drops_unknown_ends(graph):
    rows = cypher.query_graph(*graph, "MATCH (a)-[r]->(b) WHERE r.weight >= 1 RETURN a.name, b.name ORDER BY a.name").collect()
    assert [tuple(r) for r in rows] == [("n_1", "n_2"), ("n_2", "n_3"), ("n_3", "n_1")]


def test_cypher_and_binds_tighter(graph):
    rows = cypher.query_graph(*graph, "MATCH (n) WHERE n.kind = 'CLASS' AND n.startLine > 5 OR n.name = 'n_4' RETURN n").collect()
    assert [r[0] for r in rows] == ["q4"]


@pytest.mark.parametrize("text", ["CREATE (a) RETURN a", "MATCH (a) WHERE a.startLine > x RETURN a", "MATCH (a) WHERE a.name = 'x' OR RETURN a", "MATCH (a) RETURN a.nothing"])
def test_cypher_errors(graph, text):
    with pytest.raises(cypher.GraphQueryError):
        cypher.query_graph(*graph, text)


def test_trace_and_dead_code_and_cycles(graph):
    symbols, edges = graph
    assert {(r.source, r.target, r.level) for r in G.trace(edges, "q1", depth=2).collect()} == {("q1", "q2", 1), ("q2", "q3", 2)}
    assert [r.qualified_name for r in G.dead_code(symbols, edges).collect()] == ["q4"]
    assert {(r.member, r.component) for r in G.components(edges).collect()} == {(f"q{i}", "q1") for i in (1, 2, 3)}


def test_entry_point_lists_queries():
    import __spark_entry__ as e

    assert "cypher_edge_weight" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
