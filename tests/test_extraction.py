"""Extraction, sources and derived edges on a small tree of our own."""

import json

import pytest

from codeloom.extract.files import extracted, graph_of
from codeloom.extract.kernel import app_router_path, block_end, extract, http_target
from codeloom.operators import analytics as A
from codeloom.operators import derive as D
from codeloom.operators import retrieval as R
from codeloom.plans.cypher import GraphQueryError, query_graph
from codeloom.sources import git, packages, repository, state

TREE = {
    "src/api/users.ts": "import { Store } from '../db/store'\nimport cfg from '@/config'\nexport class UserService extends Base implements Loader<User> {\n  constructor() { this.store = new Store() }\n  async load(userId: string) {\n    this.store.save(userId, 'x')\n    const r = await fetch(`/api/users`, {\n      method: 'PUT'\n    })\n    return r\n  }\n}\nexport const makeUser = async (name) => {\n  const s = new Store()\n  s.save(name, 1)\n  loadConfig(name)\n}\napp.put('/api/users', makeUser)\n",
    "src/db/store.ts": "export class Store {\n  save(key: string, value: number) {\n    console.log(key)\n  }\n}\nexport class Base {\n}\nexport interface Loader {\n}\n",
    "src/config.ts": "export function loadConfig(env) {\n  return process.env.MAX_POOL_SIZE\n}\nexport const maxPoolSize = () => 1\n",
    "app/api/items/[id]/(group)/route.ts": "export async function GET(req) {\n  return 1\n}\n",
    "tools/run.py": "import os\nfrom a.b import c\n\nclass Job(Base):\n    def start(self):\n        if True:\n            pass\n\ndef main():\n    return 1\n",
    "lib/thing.rb": "require 'json'\nclass Thing\n  def go!\n    if true\n    end\n  end\nend\n",
    "config/settings.json": json.dumps({"db": {"maxPoolSize": 3, "host": "h"}, "list": [1]}),
    ".env": "export MAX_POOL_SIZE=3\n# no\nPLAIN=1\n",
    "settings.toml": "[db]\nhost = 'x'\n",
    "package.json": json.dumps({"name": "shop", "dependencies": {"axios": "^1"}, "devDependencies": {"tap": "2"}}),
    "package-lock.json": json.dumps({"packages": {"": {}, "node_modules/axios": {"version": "1.2.3"}, "node_modules/x/node_modules/tap": {"version": "v2"}}}),
    "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0"\n\n[[package]]\nname = "syn"\nversion = "2.0"\n',
    "go.mod": "module ex.com/m\n\nrequire a.com/b v1.0.0\nrequire (\n\tc.com/d v2.0.0\n)\n",
    "pom.xml": "<project><groupId>g</groupId><artifactId>a</artifactId>\n<dependency><groupId>x</groupId><artifactId>y</artifactId><version>1</version></dependency></project>",
    "schema.graphql": "type User {\n  id: ID\n}\nquery GetUser {\n  x\n}\n",
    "api.json": json.dumps({"openapi": "3", "paths": {"/pets/{petId}": {"get": {}, "x-no": {}}}}),
    "web/view.swift": 'final class V {\n  func go() {\n    NotificationCenter.default.post(name: .changed, object: nil)\n  }\n}\n',
    "docs/a.md": "# One\n\ntext\n## Two\n",
    "image.png": "x",
    "node_modules/skip.ts": "export class No {}\n",
    "yarn.lock": '"left-pad@^1.0.0", left-pad@1:\n  version "1.3.0"\n',
    "pnpm-lock.yaml": "packages:\n  /chalk@5.0.0:\n    x: 1\n  '@a/b@1.0.0(c@1)':\n    x: 1\nother: 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def files(spark, tree):
    return repository.read_tree(spark, tree, hidden=True, overrides=[(".env", "shell")]).cache()


@pytest.fixture(scope="module")
def graph(files):
    symbols, edges = graph_of(extracted(files.where("not skipped")))
    return symbols.cache(), edges.cache()


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_tree(spark, tree, files):
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == set(TREE) - {"image.png", "node_modules/skip.ts"}
    assert rows["src/api/users.ts"].language == "typescript" and rows["Cargo.lock"].language == "unknown" and not rows["Cargo.lock"].skipped
    assert rows["docs/a.md"].lines == 5 and len(rows["docs/a.md"].sha256) == 64
    small = {r.path: r.skip_reason for r in repository.read_tree(spark, tree, ignore="docs/\n*.json\n!api.json\n", max_bytes=60).collect()}
    assert "docs/a.md" not in small and "package.json" not in small and "api.json" in small and small["src/api/users.ts"].startswith("larger")
    with pytest.raises(ValueError):
        repository.read_tree(spark, tree, max_files=3)
    with pytest.raises(ValueError):
        repository.ignore_rules("x" * 501)


def test_symbols(graph):
    found = pairs(graph[0], "kind", "name", "file_path", "start_line", "end_line")
    for s in [
        ("class", "UserService", "src/api/users.ts", 3, 12), ("method", "load", "src/api/users.ts", 5, 11), ("function", "makeUser", "src/api/users.ts", 13, 17), ("route", "PUT /api/users", "src/api/users.ts", 18, 18),
        ("http_call", "PUT /api/users", "src/api/users.ts", 7, 7), ("route", "GET /api/items/:id", "app/api/items/[id]/(group)/route.ts", 1, 1), ("class", "Job", "tools/run.py", 4, 8), ("function", "start", "tools/run.py", 5, 8),
        ("class", "Thing", "lib/thing.rb", 2, 7), ("function", "go!", "lib/thing.rb", 3, 6), ("config_key", "db.maxPoolSize", "config/settings.json", 1, 1), ("config_key", "MAX_POOL_SIZE", ".env", 1, 1),
        ("config_key", "db.host", "settings.toml", 2, 2), ("package", "shop", "package.json", 1, 1), ("dependency", "axios", "package.json", 1, 1), ("locked_dependency", "tap", "package-lock.json", 1, 1), ("locked_dependency", "syn", "Cargo.lock", 5, 5),
        ("dependency", "c.com/d", "go.mod", 4, 4), ("package", "g:a", "pom.xml", 1, 1), ("dependency", "x:y", "pom.xml", 2, 2), ("graphql_type", "type User", "schema.graphql", 1, 1), ("graphql_operation", "query GetUser", "schema.graphql", 4, 4),
        ("route", "GET /pets/:petId", "api.json", 1, 1), ("channel", "changed", "__channels__", 1, 1), ("heading", "Two", "docs/a.md", 4, 4), ("locked_dependency", "left-pad", "yarn.lock", 1, 1), ("locked_dependency", "@a/b", "pnpm-lock.yaml", 4, 4),
        ("locked_dependency", "chalk", "pnpm-lock.yaml", 2, 2),
    ]:
        assert s in found, s


def test_derived(graph, files):
    symbols, edges = graph
    calls = D.call_edges(symbols, files)
    got = {(r.source, r.target): (r.type, r.weight) for r in calls.collect()}
    save, load, make = "src/db/store.ts:method:save:2", "src/api/users.ts:method:load:5", "src/api/users.ts:function:makeUser:13"
    assert got[make, save] == ("CALLS", 0.82) and got[load, save] == ("CALLS", 0.82) and got[make, "src/config.ts:function:loadConfig:1"] == ("CALLS", 0.75)
    assert got["src/api/users.ts:class:UserService:3", load] == ("CALLS_LOCAL", 1.0) and ("src/api/users.ts:file", "src/config.ts:function:loadConfig:1") in got
    types = pairs(D.type_edges(symbols, files), "source", "target", "type")
    service = "src/api/users.ts:class:UserService:3"
    assert (service, "src/db/store.ts:class:Base:6", "INHERITS") in types and (service, "src/db/store.ts:interface:Loader:8", "IMPLEMENTS") in types and (make, "src/db/store.ts:class:Store:1", "USES_TYPE") in types
    assert (service, "src/db/store.ts:class:Base:6", "USES_TYPE") not in types and ("tools/run.py:class:Job:4", "src/db/store.ts:class:Base:6", "INHERITS") in types
    flow = {(r.source, r.target): [tuple(m) for m in r.mappings] for r in D.dataflow_edges(symbols, files, calls).collect()}
    assert flow[make, save] == [("name", "key")] and flow[load, save] == [("userId", "key")] and flow[make, "src/config.ts:function:loadConfig:1"] == [("name", "env")]
    assert pairs(D.http_edges(symbols), "source", "target", "weight") == {(load, "src/api/users.ts:route:PUT /api/users:18", 0.9)}
    keys = pairs(D.config_key_edges(symbols), "source", "target")
    assert ("config/settings.json:config_key:db.maxPoolSize:1" in {s for s, _ in keys}) or (".env:config_key:MAX_POOL_SIZE:1", "src/config.ts:function:maxPoolSize:4") in keys
    used = pairs(D.config_reference_edges(symbols, files.where("not skipped")), "source", "target")
    assert (".env:config_key:MAX_POOL_SIZE:1", "src/config.ts:function:loadConfig:1") in used
    said = edges.where("type = 'IMPORTS'").selectExpr("regexp_replace(source, ':file$', '') AS path", "regexp_replace(target, '^external:', '') AS name")
    assert pairs(D.import_edges(said, files), "source", "target", "resolver") >= {("src/api/users.ts:file", "src/db/store.ts:file", "relative"), ("src/api/users.ts:file", "src/config.ts:file", "source-root")}


@pytest.mark.parametrize(
    "name, want",
    [("../../../etc/passwd", None), ("./b", "src/b.ts"), ("@app/x/y", "lib/x/y.ts"), ("@app/../y", None), ("shop/util", "packages/shop/util.ts"), ("shop", "packages/shop/src/index.ts"), ("a.b.C", "src/a/b/C.java"), ("@/b", "src/b.ts"), ("a\\b\\C", "src/a/b/C.java"), ("/etc/x", None)],
)
def test_imports_resolve_inside_the_root(spark, name, want):
    files = spark.createDataFrame([(p,) for p in ("src/b.ts", "lib/x/y.ts", "packages/shop/util.ts", "packages/shop/src/index.ts", "src/a/b/C.java", "y.ts", "etc/passwd")], "path string")
    got = D.import_edges(spark.createDataFrame([("src/a.ts", name)], "path string, name string"), files, aliases=[("@app/*", ["lib/*"])], packages=[("shop", "packages/shop")]).collect()
    assert [r.target for r in got] == ([f"{want}:file"] if want else [])


def test_dependency_scope(spark):
    symbols = spark.createDataFrame([("p/package.json:dependency:axios:1", "axios", "dependency", "p/package.json"), ("pom.xml:dependency:org.acme:fast-json:1", "org.acme:fast-json", "dependency", "pom.xml")], "qualified_name string, name string, kind string, file_path string")
    imports = spark.createDataFrame([("p/a.ts", "axios/lib"), ("q/a.ts", "axios"), ("q/B.java", "org.acme.json.Reader")], "path string, name string")
    assert pairs(D.dependency_edges(symbols, imports), "source", "target") == {("p/package.json:dependency:axios:1", "p/a.ts:file"), ("pom.xml:dependency:org.acme:fast-json:1", "q/B.java:file")}


def test_similarity_by_brute_force(spark):
    body = "alpha beta gamma delta epsilon zeta"
    texts = {"a": body, "b": body, "c": body.replace("zeta", "theta"), "d": "other words entirely standing alone here"}
    files = spark.createDataFrame([(f"{k}.ts", v) for k, v in texts.items()], "path string, text string")
    symbols = spark.createDataFrame([(k, f"{k}fun", "function", f"{k}.ts", "typescript", 1, 1, None) for k in texts], "qualified_name string, name string, kind string, file_path string, language string, start_line int, end_line int, signature string")
    got = {(r.source, r.target): r.type for r in D.similarity_edges(symbols, files).collect()}
    assert got[("a", "b")] == "SIMILAR_TO" and got[("a", "c")] == "SEMANTICALLY_RELATED" and not any("d" in k for k in got)


def test_small_rules():
    assert app_router_path("x/app/api/route.ts") == "/api" and app_router_path("app/api/[...all]/[[...o]]/route.js") == "/api/*all/*o?" and app_router_path("app/page.ts") is None
    assert http_target("https://u@H.com:80/a/?q") == {"path": "/a", "host": "h.com:80", "scheme": "https", "url": "https://h.com:80/a", "urlKind": "absolute"} and http_target("ftp://x/y") is None and http_target("a/b") is None
    assert block_end("go", ["func a() {", "}", "x"], 1) == 2 and block_end("go", ["func a()"], 1) == 1 and block_end("python", ["def a():", "  x", "", "y"], 1) == 3
    assert D.parameters("f(a: string, public b = 1, ...rest, {c})") == ["a", "b", "rest"] and D.flows("g(')', x, f(y))", "g", "g(p, q, r)") == [("x", "q"), ("f(y)", "r")]
    docker = extract("Dockerfile", "shell", "FROM a AS one\nFROM b\nCOPY --from=one x y\nCOPY --from=0 x y\n")
    assert sum(e["metadata"].find("COPY") >= 0 for e in docker.edges) == 2
    kust = extract("k/kustomization.yaml", "yaml", "resources:\n  - ../base\n  - https://x/y\n")
    assert {e["target"] for e in kust.edges if e["type"] == "IMPORTS"} == {"base:file", "external:https://x/y:file"}


def test_git():
    assert git.parse_status(" M a.ts\0R  new.ts\0old.ts\0?? x y\0D  gone\0") == [("a.ts", "modified", None), ("new.ts", "renamed", "old.ts"), ("x y", "untracked", None), ("gone", "deleted", None)]
    log = "\x1eh2\x1fAnn\x1f2024-02\n\n3\t1\ta.ts\n-\t-\tb.png\n\x1eh1\x1fBob\x1f2024-01\n\n5\t0\ta.ts\n"
    assert git.parse_log(log) == [("h2", "Ann", "2024-02", "a.ts", 3, 1), ("h2", "Ann", "2024-02", "b.png", 0, 0), ("h1", "Bob", "2024-01", "a.ts", 5, 0)]


def test_packages(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    path = f"{tmp_path}/p"
    packages.export({"symbols": a}, path)
    assert packages.load(spark, path)["symbols"].count() == 2 and packages.bootstrap(spark, path, f"{tmp_path}/g") and not packages.bootstrap(spark, path, f"{tmp_path}/g")
    with pytest.raises(FileExistsError):
        packages.unpack(spark, path, f"{tmp_path}/g")
    a.union(a).write.mode("overwrite").parquet(f"{path}/symbols")
    with pytest.raises(ValueError):
        packages.load(spark, path)


def test_state(tmp_path):
    d = state.Decisions(f"{tmp_path}/d.json")
    one, two = d.add("A", "b", tags=["x"]), d.add("C", "d", status="accepted")
    assert d.update(one["id"], status="deprecated")["status"] == "deprecated" and [r["id"] for r in d.list()] == [2, 1] and d.delete(two["id"]) and d.get(2) is None
    with pytest.raises(ValueError):
        d.add("x", "y", status="odd")
    c = state.Config(f"{tmp_path}/c.json")
    assert c.set("limit", "7") == 7 and c.get("search.limit") == 7 and c.set("tests", "yes") is True
    c.reset("limit")
    assert c.get("limit") == 20
    cat = state.Catalog(f"{tmp_path}/p.json")
    cat.record("/a/b", files=3), cat.record("/c/d"), cat.record("/a/b", files=4)
    assert [r["label"] for r in cat.read()] == ["b", "d"] and cat.find("b")["files"] == 4 and cat.forget("/c/d") and not cat.forget("no")
    with state.locked(f"{tmp_path}/l"), pytest.raises(BlockingIOError), state.locked(f"{tmp_path}/l"):
        pass
    log = state.Diagnostics(f"{tmp_path}/log")
    log.event("x", text="secret", note="n" * 900)
    assert "secret" not in open(log.path).read() and len(open(log.path).read()) < 700
    runs = state.Runs(f"{tmp_path}/r.json")
    runs.record("/x"), runs.record("/y")
    assert runs.latest_root() == "/y" and state.benchmark({"a": lambda: 3})[0]["items"] == 3


def test_reports_and_upkeep(spark, graph, files):
    symbols, edges = graph
    lines = R_lines(files)
    sections = A.architecture(symbols, edges, files, lines)
    assert "## totals" in A.report(sections) and "<h2>totals</h2>" in A.report(sections, as_html=True) and isinstance(A.recommendations(sections), list)
    gone = spark.createDataFrame([("web/view.swift",)], "path string")
    s, e, left = A.without_files(gone, symbols, edges, lines)
    assert s.where("file_path IN ('web/view.swift', '__channels__')").isEmpty() and e.where("source LIKE 'web/%' OR target LIKE 'channel:%'").isEmpty() and left.where("path = 'web/view.swift'").isEmpty()
    assert R.snippet(symbols, files, "docs/a.md").count() == 5 and R.snippet(symbols, files, "src/config.ts:2", context=1).count() == 3


def R_lines(files):
    from codeloom.operators.search import code_lines

    return code_lines(files.where("not skipped"))


@pytest.mark.parametrize("text", ["MATCH (n) RETURN n LIMIT 1.5", "MATCH (n) RETURN n SKIP -1", "MATCH (n) RETURN n.doc", "MATCH (n) WHERE n.name = 'a' OR RETURN n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) WHERE n.startLine > 'x' RETURN n"])
def test_cypher_errors(graph, text):
    with pytest.raises(GraphQueryError):
        query_graph(*graph, text)


def test_cypher_details(graph):
    assert query_graph(*graph, "MATCH (n) WHERE n.name = 'order by x.y' RETURN DISTINCT n.kind ORDER BY n.name").count() == 0
    assert query_graph(*graph, "MATCH (n:Class) RETURN n, n.signature LIMIT 1").columns == ["n.qualifiedName", "n.signature"]
    assert query_graph(*graph, "MATCH (n) RETURN count(n) SKIP 1").count() == 0 and query_graph(*graph, "MATCH (n) RETURN count(n) LIMIT 1").count() == 1
