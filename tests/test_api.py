"""The facade on two small repositories: every entry point answers."""

import pytest

from codeloom.api import Graph, fleet
from codeloom.operators import derive as D
from codeloom.streaming.traces import read_traces

SHOP = {
    "src/app/main.ts": "import { save } from '@lib/store'\nexport function start(order) {\n  save(order)\n  fetch('https://billing.example.com/pay', { method: 'POST' })\n}\n",
    "src/lib/store.ts": "export function save(item) {\n  // TODO api_key\n  return item\n}\nfunction unused() {\n}\n",
    "tsconfig.json": '{ // paths\n  "compilerOptions": { "paths": { "@lib/*": ["src/lib/*",], "@bad/*": ["../../*"] } },\n}\n',
    "package.json": '{"name": "shop", "dependencies": {"axios": "1"}}',
    "settings.py": 'password = "abcdEFGH12345678"\n',
}
BILLING = {"server.ts": "app.post('/pay', h)\nfunction h(x) {\n}\n", "package.json": '{"name": "billing", "dependencies": {"axios": "1"}}'}


def written(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    return Graph.index(spark, written(tmp_path_factory.mktemp("shop"), SHOP))


def test_graph(spark, shop, tmp_path):
    start, save = "src/app/main.ts:function:start:2", "src/lib/store.ts:function:save:1"
    edges = {(r.source, r.target, r.type) for r in shop.edges.collect()}
    assert (start, save, "CALLS") in edges and (start, save, "DATA_FLOWS") in edges and ("src/app/main.ts:file", "src/lib/store.ts:file", "IMPORTS_FILE") in edges
    assert [r.target for r in shop.trace("start", mode="calls", depth=1).collect()] == [save]
    assert shop.search_code("save").count() > 0 and shop.search_symbols("sav").first().name == "save" and shop.find_references("save").first().kind == "definition"
    assert shop.snippet("save", context=0).count() == 4 and shop.semantic_search("start order").first().qualified_name == start and not shop.vector_search("save item").isEmpty()
    assert not shop.context_pack("save").isEmpty() and shop.query("MATCH (a)-[r:CALLS]->(b) WHERE b.name = 'save' RETURN count(*)").first()[0] >= 1
    found, totals = shop.scan_secrets()
    assert found.first().kind == "sensitive_assignment" and totals.first().files >= 1 and "EFGH1234" not in str(found.collect())
    assert [r.name for r in shop.dead_code().collect()] == ["unused"] and shop.cycles().isEmpty() and not shop.impact(["src/lib/store.ts"]).isEmpty()
    assert set(shop.schema()) == {"totals", "languages", "labels", "edge_types", "patterns", "properties"} and "## markers" in shop.report() and shop.snapshot(limit=3)[0].count() == 3
    assert shop.communities(min_members=2).columns[0] == "id" and shop.search_graph(text="start", limit=5).count() >= 1 and shop.detect_changes(str(tmp_path))[1].first().risk == "none"
    more, bad = shop.ingest(read_traces(spark, '[{"source": "start", "channel": "paid"}, {"source": "nobody", "channel": "x"}]'))
    assert more.edges.where("type = 'OBSERVED_EMITS'").count() == 1 and bad.count() == 1 and more.symbols.where("name = 'paid'").count() == 1
    shop.pack(f"{tmp_path}/pack")
    assert Graph.unpack(spark, f"{tmp_path}/pack").symbols.count() == shop.symbols.count()
    assert shop.updated(shop.files) is shop and shop.changed(shop.files.where("path <> 'settings.py'")).where("change = 'removed'").count() == 1


def test_fleet(spark, shop, tmp_path):
    got = fleet({"shop": shop, "billing": Graph.index(spark, written(tmp_path, BILLING), similar=False)})
    assert [(r.consumer, r.provider, r.confidence) for r in got["service_links"].collect()] == [("shop", "billing", 0.95)]
    assert [r.name for r in got["shared_dependencies"].collect()] == ["axios"] and got["edges"].where("type = 'CROSS_REPO_HTTP_CALLS'").count() == 1 and got["languages"].count() > 0


def test_relaxed_json():
    assert D.relaxed_json('{"a": "x // y", /* c */ "b": [1, 2,], }') == {"a": "x // y", "b": [1, 2]} and D.relaxed_json("{") is None
    assert D.aliases_of("web/tsconfig.json", SHOP["tsconfig.json"]) == [("@lib/*", ["web/src/lib/*"])]
