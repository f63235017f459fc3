"""One object for all questions about a graph: tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract.files import extracted, graph_of
from .operators import analytics as A
from .operators import derive as D
from .operators import fleet as E
from .operators import graph as G
from .operators import retrieval as R
from .operators import search as S
from .operators import secrets as X
from .plans.cypher import query_graph
from .sources import git, packages, repository
from .streaming import traces as T
from .tables import stored


@dataclass(frozen=True)
class Graph:
    """``files, symbols, edges`` of a repository; every method is lazy but for the walks."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame

    # --- making and moving ---

    @classmethod
    def index(cls, spark: SparkSession, root: str, *, similar: bool = True, **options) -> Graph:
        """Read a source tree, extract its symbols and derive the edges between files."""
        files = stored(repository.read_tree(spark, root, **options), "files")
        return cls.of_files(files, similar=similar)

    @classmethod
    def of_files(cls, files: DataFrame, *, similar: bool = True) -> Graph:
        read = files.where(~F.col("skipped"))
        symbols, edges = graph_of(stored(extracted(read), "extracted"))
        symbols, edges = stored(symbols, "symbols"), edges.select("source", "target", "type", "weight")
        imports = edges.where("type = 'IMPORTS'").select(F.regexp_replace("source", ":file$", "").alias("path"), F.regexp_replace("target", "^external:", "").alias("name"))
        configs = read.where(F.col("path").rlike(r"(^|/)[tj]sconfig[^/]*\.json$")).select("path", "text").collect()  # a few small files
        aliases = [a for r in configs for a in D.aliases_of(r["path"], r["text"])]
        calls = stored(D.call_edges(symbols, read), "calls")
        derived = [calls, D.type_edges(symbols, read), D.dataflow_edges(symbols, read, calls), D.http_edges(symbols), D.config_key_edges(symbols), D.config_reference_edges(symbols, read), D.dependency_edges(symbols, imports)]
        derived.append(D.import_edges(imports, read, aliases=aliases, packages=D.packages_of(symbols)))
        if similar:
            derived.append(D.similarity_edges(symbols, read))
        for more in derived:
            edges = edges.unionByName(more.select("source", "target", "type", "weight"))
        return cls(files, symbols, stored(D.strongest(edges), "edges"))

    def pack(self, path: str) -> dict:
        return packages.export({"files": self.files, "symbols": self.symbols, "edges": self.edges}, path)

    @classmethod
    def unpack(cls, spark: SparkSession, path: str) -> Graph:
        t = packages.load(spark, path)
        return cls(t["files"], t["symbols"], t["edges"])

    def changed(self, newer: DataFrame) -> DataFrame:
        """How the files of a newer reading differ from these."""
        return repository.diff(self.files, newer)

    def updated(self, newer: DataFrame) -> Graph:
        """The graph of a newer reading; these very tables if no file changed."""
        return self if self.changed(newer).where("change <> 'unchanged'").isEmpty() else Graph.of_files(newer)

    # --- search ---

    @property
    def lines(self) -> DataFrame:
        return S.code_lines(self.files.where(~F.col("skipped")))

    def search_code(self, query: str, *, limit: int = 20) -> DataFrame:
        return R.search_code(self.lines, None, None, query, limit=limit)

    def search_symbols(self, query: str, *, kind: str | None = None, limit: int = 20) -> DataFrame:
        return R.symbol_search(self.symbols, query, kind=kind, limit=limit)

    def find_references(self, name: str, *, limit: int = 100) -> DataFrame:
        return R.references(self.symbols, self.lines, name, limit=limit)

    def snippet(self, name: str, *, context: int = 4) -> DataFrame:
        return R.snippet(self.symbols, self.files, name, context=context)

    def search_graph(self, **filters) -> DataFrame:
        return G.search_graph(self.symbols, self.edges, **filters)

    def semantic_search(self, query: str, *, limit: int = 20) -> DataFrame:
        return R.semantic_search(self.symbols, self.files, query, limit=limit)

    def vector_search(self, query: str, *, limit: int = 20) -> DataFrame:
        return R.hashed_search(R.vector_index(self.symbols, self.files), query, limit=limit)

    def context_pack(self, query: str, *, limit: int = 6) -> DataFrame:
        return R.context_pack(self.symbols, self.edges, self.files, self.lines, query, limit=limit)

    def query(self, text: str, limit: int = 100) -> DataFrame:
        return query_graph(self.symbols, self.edges, text, limit)

    def scan_secrets(self, *, limit: int = 50, **options) -> tuple[DataFrame, DataFrame]:
        """The findings to look at first, and the totals of all."""
        found = stored(X.scan(self.lines, **options), "findings")
        return X.ranked(found, limit=limit), X.totals(found)

    # --- analysis ---

    def trace(self, name: str, **options) -> DataFrame:
        return G.trace(self.edges, name, symbols=self.symbols, **options)

    def impact(self, items: list[str], *, limit: int = 50) -> DataFrame:
        asked = self.symbols.sparkSession.createDataFrame([(i,) for i in items], "item string")
        return G.impact(self.edges, G.seeds_of(self.symbols, asked), limit=limit)

    def detect_changes(self, root: str) -> tuple[DataFrame, DataFrame]:
        """Each changed file's reach, and the risk of all changes together."""
        changes = git.changed_files(self.symbols.sparkSession, root)
        radius = A.blast_radius(changes.select("path", "status"), self.symbols, self.edges, self.files)
        items = changes.select(F.col("path").alias("item"))
        return radius, A.change_risk(radius, G.impact(self.edges, G.seeds_of(self.symbols, items), limit=100))

    def schema(self) -> dict[str, DataFrame]:
        return {
            "totals": A.graph_totals(self.symbols, self.edges, self.files), "languages": A.languages(self.symbols, self.files), "labels": A.counts(self.symbols, "kind"), "edge_types": A.counts(self.edges, "type"),
            "patterns": A.relationship_patterns(self.symbols, self.edges), "properties": A.label_properties(self.symbols),
        }

    def communities(self, *, limit: int = 20, min_members: int = 4, exact: bool = False) -> DataFrame:
        labels = A.communities_exact(self.symbols, self.edges).drop("project") if exact else A.communities(self.symbols, self.edges)
        return A.community_summary(A.split_large(labels, self.symbols), self.symbols, self.edges, min_members=min_members, limit=limit)

    def dead_code(self, *, limit: int = 50) -> DataFrame:
        return G.dead_code(self.symbols, self.edges, limit=limit)

    def cycles(self, *, limit: int = 20) -> DataFrame:
        return G.cycles(G.cluster_links(self.symbols, self.edges), limit=limit)

    def architecture(self, root: str | None = None) -> dict[str, DataFrame]:
        history = git.hotspots(git.history(self.symbols.sparkSession, root)) if root else None
        return A.architecture(self.symbols, self.edges, self.files, self.lines, cluster_links=G.cluster_links(self.symbols, self.edges), history=history)

    def report(self, root: str | None = None, *, as_html: bool = False) -> str:
        return A.report(self.architecture(root), as_html=as_html)

    def snapshot(self, *, limit: int = 500) -> tuple[DataFrame, DataFrame]:
        return A.snapshot(self.symbols, self.edges, limit=limit)

    def ingest(self, traces: DataFrame) -> tuple[Graph, DataFrame]:
        """The graph with observed edges and channels, and the traces that name nothing known."""
        edges, channels, unresolved = T.ingest(traces, self.symbols, self.files)
        both = stored(D.strongest(self.edges.unionByName(edges)), "edges")
        new = channels.select("qualified_name", "name", F.lit("channel").alias("kind"), F.lit("__channels__").alias("file_path"), F.lit("unknown").alias("language"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("exported"), F.lit('{"observed": true}').alias("metadata"))
        return Graph(self.files, stored(self.symbols.unionByName(new), "symbols"), both), unresolved


def fleet(graphs: dict[str, Graph]) -> dict[str, DataFrame]:
    """What several projects share: languages, dependencies, routes, calls to each other's routes, and the drawing of all that."""
    tag = lambda pick: [pick(g).withColumn("project", F.lit(name)) for name, g in graphs.items()]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    languages = union(tag(lambda g: A.languages(g.symbols, g.files)))
    kind = lambda *kinds: union(tag(lambda g: g.symbols.where(F.col("kind").isin(*kinds)).select("name", "metadata")))
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    dependencies = kind("dependency").select("project", "name").distinct()
    routes = kind("route").select("project", E.endpoint(told("method"), told("path")).alias("endpoint")).distinct()
    calls = kind("http_call").select("project", E.endpoint(told("method"), told("path")).alias("endpoint"), told("method").alias("method"), told("host").alias("host"))
    names = kind("package").select("project", "name").union(languages.select("project", F.col("project").alias("name"))).distinct()
    links = stored(E.service_links(routes, calls, names), "links")
    nodes, edges = E.fleet_graph(languages, dependencies, routes, calls.select("project", "endpoint").distinct(), links)
    return {"languages": E.fleet_languages(languages), "shared_dependencies": E.shared(dependencies, "name"), "route_overlaps": E.shared(routes, "endpoint"), "service_links": links, "nodes": nodes, "edges": edges}
