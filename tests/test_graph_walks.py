"""Walks, components, communities, traces and streams against plain Python."""

import json
import random

import pytest

from codeloom.operators import analytics as A
from codeloom.operators import fleet as E
from codeloom.operators import graph as G
from codeloom.operators import retrieval as R
from codeloom.streaming import traces as S


def edges_of(spark, pairs, type_="CALLS"):
    return spark.createDataFrame([(a, b, type_, float(w)) for a, b, w in pairs], "source string, target string, type string, weight double")


def test_components(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {}
    for n in nodes:
        same = {m for m in nodes if m in reach[n] and n in reach[m]}
        if len(same) > 1:
            want[n] = min(same)
    got = {r.member: r.component for r in G.components(spark.createDataFrame(list(pairs), "source string, target string")).collect()}
    assert got == want and want
    assert G.components(spark.createDataFrame([("a", "b")], "source string, target string")).isEmpty()


def test_cycles(spark):
    symbols = spark.createDataFrame([(f"{p}:file", p) for p in ("src/a/x.ts", "src/b/y.ts", "src/c/z.ts")], "qualified_name string, file_path string")
    edges = edges_of(spark, [("src/a/x.ts:file", "src/b/y.ts:file", 1), ("src/b/y.ts:file", "src/a/x.ts:file", 1), ("src/b/y.ts:file", "src/c/z.ts:file", 1)], "IMPORTS_FILE")
    rows = G.cycles(G.cluster_links(symbols, edges)).collect()
    assert len(rows) == 1 and rows[0].members == ["src/a", "src/b"] and rows[0].edges == 2 and len(rows[0].samples) == 2


def test_trace(spark):
    pairs = [("a", "b", 3), ("a", "c", 2), ("b", "d", 1), ("d", "a", 1), ("x", "a", 1), ("a", "test/f.ts:function:f:1", 1)]
    edges = edges_of(spark, pairs)
    at = lambda **k: {(r.source, r.target): r.level for r in G.trace(edges, "a", **k).collect()}
    assert at(depth=3) == {("a", "b"): 1, ("a", "c"): 1, ("a", "test/f.ts:function:f:1"): 1, ("b", "d"): 2, ("d", "a"): 3}
    assert at(depth=2, direction="inbound") == {("d", "a"): 1, ("x", "a"): 1, ("b", "d"): 2}
    both = at(depth=1, direction="both")
    assert set(both) == {("a", "b"), ("a", "c"), ("a", "test/f.ts:function:f:1"), ("d", "a"), ("x", "a")}
    assert ("a", "test/f.ts:function:f:1") not in at(include_tests=False) and set(at(depth=1, fan_out=1)) == {("a", "b")}
    assert at(mode="cross_service") == {} and G.trace(edges, "zz", symbols=spark.createDataFrame([("a", "a", 1)], "name string, qualified_name string, exported int")).isEmpty()
    flows = spark.createDataFrame([("a", "b", "DATA_FLOWS", 1.0, [("x", "id")]), ("a", "c", "DATA_FLOWS", 1.0, [("y", "no")])], "source string, target string, type string, weight double, mappings array<struct<argument:string,parameter:string>>")
    assert [r.target for r in G.trace(flows, "a", parameter="id", depth=1).collect()] == ["b"]
    with pytest.raises(ValueError):
        G.trace(edges, "a", direction="up")


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1) for i in range(5) for j in range(i)]
    edges = edges_of(spark, clique("a") + clique("b") + [("a0", "b0", 1)])
    symbols = spark.createDataFrame([(f"{p}{i}", f"n{p}{i}", "function", f"src/{p}/f.ts", "typescript") for p in "ab" for i in range(5)], "qualified_name string, name string, kind string, file_path string, language string")
    for found in (A.communities(symbols, edges), A.communities_exact(symbols, edges).drop("project")):
        label = {r.id: r.label for r in found.collect()}
        assert len({label[f"a{i}"] for i in range(5)}) == 1 == len({label[f"b{i}"] for i in range(5)}) and label["a1"] != label["b1"]
    rows = A.community_summary(A.split_large(A.communities(symbols, edges), symbols), symbols, edges).collect()
    assert [(r.members, r.internal, r.external, r.cohesion) for r in rows] == [(5, 10, 1, 0.9091)] * 2 and all(r.id.startswith("community-") for r in rows)


def test_search_and_references(spark):
    assert R.clamp("x", 1, 5) == 1 and R.clamp(9.7, 1, 5) == 5 and R.clamp(None, 2, 5) == 2
    lines = spark.createDataFrame([("a.ts", 1, "parseHTTPUrl(x)"), ("a.ts", 2, "nothing"), ("b.ts", 1, "url url2 $url")], "path string, line int, text string")
    index, totals = R.line_index(R.tokenized(lines)), R.index_totals(R.tokenized(lines))
    assert [(r.path, r.line) for r in R.search_index(index, totals, "http").collect()] == [("a.ts", 1)]
    assert [(r.path, r.line) for r in R.search_code(lines, index, totals, "l2 $").collect()] == [("b.ts", 1)] and R.search_index(index, totals, "!").isEmpty()
    symbols = spark.createDataFrame([("a.ts:function:url:1", "url", "function", "a.ts", 1, 2, 0)], "qualified_name string, name string, kind string, file_path string, start_line int, end_line int, exported int")
    assert [(r.path, r.kind) for r in R.references(symbols, lines, "url").collect()] == [("b.ts", "reference")]


def test_ingest(spark):
    symbols = spark.createDataFrame(
        [("a.ts:function:go:1", "go", "function", "a.ts", 1, 1, "{}"), ("b.ts:function:goAway:1", "goAway", "function", "b.ts", 1, 0, "{}"), ("a.ts:route:GET /x:2", "GET /x", "route", "a.ts", 2, 1, json.dumps({"method": "GET", "path": "/x"}))],
        "qualified_name string, name string, kind string, file_path string, start_line int, exported int, metadata string",
    )
    files = spark.createDataFrame([("a.ts",), ("c.md",)], "path string")
    given = [
        {"source": "go", "method": "get", "path": "http://h/x?y=1", "count": 5000}, {"source": "a.ts#go", "channel": "'user'", "direction": "listen"}, {"source": "Away", "target": "c.md", "edgeType": "reads file"},
        {"source": "none", "target": "go"}, {"source": "go", "method": "POST", "path": "/x"}, {"source": "go", "target": "missing"},
    ]
    edges, channels, bad = S.ingest(S.read_traces(spark, json.dumps({"traces": given})), symbols, files)
    assert {(r.source, r.target, r.type, r.weight) for r in edges.collect()} == {
        ("a.ts:function:go:1", "a.ts:route:GET /x:2", "OBSERVED_HTTP_CALLS", 1000.0), ("a.ts:function:go:1", "channel:user", "OBSERVED_LISTENS_ON", 1.0), ("b.ts:function:goAway:1", "c.md:file", "OBSERVED_READS_FILE", 1.0),
    }
    assert [r.name for r in channels.collect()] == ["user"] and sorted(r.reason for r in bad.collect()) == ["route not found", "source not found", "symbol not found"]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "click"), (1, "click"), (2, "view")], "user_id long, event_type string")
    events.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).json(f"{tmp_path}/in")
    S.stream_edges(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, S.latest_edges(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, S.observed_edges(events).collect()))
    rows = "path string, content binary"
    for turn, text in enumerate((b"def one():\n  pass\n", b"def two():\n  pass\n")):
        spark.createDataFrame([("a.py", bytearray(text))], rows).write.mode("append").parquet(f"{tmp_path}/files")
        S.stream_index(spark.readStream.schema(rows).parquet(f"{tmp_path}/files"), f"{tmp_path}/index", f"{tmp_path}/ck2").awaitTermination()
    files, found = S.current_index(spark, f"{tmp_path}/index")
    assert files.count() == 1 and [r.symbol["name"] for r in found.where("symbol.kind = 'function'").collect()] == ["two"]


def test_service_links(spark):
    routes = spark.createDataFrame([("billing-api", "GET /a"), ("other", "GET /b"), ("third", "GET /b")], "project string, endpoint string")
    calls = spark.createDataFrame([("web", "GET /a", "GET", "billing.example.com:80"), ("web", "GET /b", "GET", None), ("app", "GET /a", "GET", "elsewhere.org"), ("cli", "GET /a", "GET", "localhost")], "project string, endpoint string, method string, host string")
    names = spark.createDataFrame([("billing-api", "@acme/billing-api"), ("other", "other"), ("third", "third")], "project string, name string")
    got = {(r.consumer, r.provider): (r.confidence, r.reason) for r in E.service_links(routes, calls, names).collect()}
    assert got == {("web", "billing-api"): (0.95, "method_path_host"), ("web", "other"): (0.45, "method_path_ambiguous"), ("web", "third"): (0.45, "method_path_ambiguous"), ("cli", "billing-api"): (0.85, "method_path_unique")}


def test_change_risk(spark):
    radius = spark.createDataFrame([("a", 10, "low"), ("b", 40, "medium")], "path string, direct_edges long, risk string")
    assert A.change_risk(radius, spark.createDataFrame([("x",)], "item string")).first().risk == "medium"
    assert A.change_risk(radius.where("false"), spark.createDataFrame([], "item string")).first().risk == "none"
