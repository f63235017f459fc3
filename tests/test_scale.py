"""Operators on tables of which a plan must not make more rows, tasks or broadcasts than the job needs."""

import itertools
import random

from codeloom.operators import derive as D


def test_similarity_pairs_are_compared_only_where_they_may_be_alike(spark, monkeypatch):
    draw, held = random.Random(3), {}
    stored = D.stored
    monkeypatch.setattr(D, "stored", lambda df, label: held.setdefault(label, stored(df, label)))
    # all share one word that few enough hold, and some of their other words; every eighth is a changed copy
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = []
    for k in range(64):
        texts.append(f"{texts[-1]} plus{chr(97 + k // 8)}x" if k % 8 == 7 else " ".join(["shared", *draw.sample(words, 30)]))
    ids = [f"s{k:02}" for k in range(64)]
    files = spark.createDataFrame([(f"{i}.ts", t) for i, t in zip(ids, texts)], "path string, text string")
    symbols = spark.createDataFrame([(i, "", "function", f"{i}.ts", "typescript", 1, 1, None) for i in ids], "qualified_name string, name string, kind string, file_path string, language string, start_line int, end_line int, signature string")
    got = {(r.source, r.target): (r.type, r.weight) for r in D.similarity_edges(symbols, files, most=None).collect()}
    stem = lambda w: w[:-1] if w.endswith("s") and len(w) > 4 else w
    body = {i: {stem(w) for w in t.split()} for i, t in zip(ids, texts)}
    all_ = {i: body[i] | {i} for i in ids}
    few = {w for w in set().union(*all_.values()) if 2 <= sum(w in x for x in all_.values()) <= 80}
    want, related = {}, []
    for a, b in itertools.combinations(ids, 2):
        hits, both = len(all_[a] & all_[b] & few), len(all_[a] & all_[b])
        score = hits / (len(all_[a]) + len(all_[b]) - both)
        if hits and len(body[a] & body[b]) / len(body[a] | body[b]) >= 0.78:
            want[a, b] = ("SIMILAR_TO", round(score, 4))
        elif hits and score >= 0.22 and both >= 2:
            related.append((a, -score, b))
    for _, rows in itertools.groupby(sorted(related), lambda r: r[0]):
        want |= {(a, b): ("SEMANTICALLY_RELATED", round(-s, 4)) for a, s, b in list(rows)[:5]}
    assert got == want and sum(t == "SIMILAR_TO" for t, _ in want.values()) == 8
    pairs = [t.count() for t in held.values() if {"a", "b"} <= set(t.columns)]
    assert pairs and max(pairs) < 500  # of 2016 pairs with a word in common


def test_extraction_is_dealt_to_many_tasks(spark):
    from codeloom.extract.files import extracted

    files = spark.createDataFrame([(f"{k}.py", "python", f"def f{k}():\n    pass") for k in range(40)], "path string, language string, text string").coalesce(1)
    assert extracted(files).rdd.getNumPartitions() == 4


def test_http_edges_deal_busy_paths_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    meta = '{{"method": "{}", "path": "/a"}}'.format
    rows = [(f"r{k}", "route", f"r{k}.ts", 1, 1, meta("ANY" if k == 0 else "POST")) for k in range(30)]
    rows += [(f"c{k}", "http_call", f"c{k}.ts", 2, 2, meta("ANY" if k == 1 else "POST")) for k in range(20)]
    symbols = spark.createDataFrame(rows, "qualified_name string, kind string, file_path string, start_line int, end_line int, metadata string")
    edges = D.http_edges(symbols)
    want = {(f"c{k}.ts:file", f"r{j}", 0.9) for k in range(20) if k != 1 for j in range(1, 30)} | {("c1.ts:file", "r0", 0.65)}
    got = [tuple(r) for r in edges.select("source", "target", "weight").collect()]
    assert set(got) == want and len(got) == len(want)
    place = D._met(spark.createDataFrame([(f"c{k}", "/a", "POST", 0.9) for k in range(20)], "source string, at string, method string, weight double"), spark.createDataFrame([("/a", "POST", f"r{j}") for j in range(30)], "at string, method string, target string"))
    assert place.count() == 600 and place.select("row", "column").distinct().count() > 20


def test_config_keys_meet_sets_of_words(spark, monkeypatch):
    held, stored = {}, D.stored
    monkeypatch.setattr(D, "stored", lambda df, label: held.setdefault(label, stored(df, label)))
    rows = [("k1", "maxPoolSize", "config_key", "s.json", '{"key": "db.maxPoolSize"}'), ("k2", "x", "config_key", "s.json", '{"key": "x.red_fox"}')]
    rows += [(f"f{k}", f"max_pool_{k}", "function", "a.ts", None) for k in range(50)] + [("g", "poolMaxSize", "function", "a.ts", None), ("h", "theRedBigFox", "class", "b.ts", None), ("i", "redFox", "class", "s.json", None)]
    got = D.config_key_edges(spark.createDataFrame(rows, "qualified_name string, name string, kind string, file_path string, metadata string"))
    assert {(r.source, r.target) for r in got.collect()} == {("k1", "g"), ("k2", "h")}
    assert held["held-words"].select("held").distinct().count() == 3  # fifty names that hold the same words of keys are one set


def test_history_has_no_window_over_all_rows(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["history_hotspots"](spark, "/root/testdata/sf0.001")
    assert "Window" not in df._jdf.queryExecution().toString()


def test_exact_communities_of_parts_in_different_tasks(spark):
    import random

    from codeloom.operators import analytics as A

    draw, links = random.Random(5), set()
    for part in range(6):
        links |= {(f"n{part}x{draw.randrange(15)}", f"n{part}x{draw.randrange(15)}") for _ in range(30)}
    links = sorted(links)
    ids = sorted({x for e in links for x in e} | {"alone"})
    symbols = spark.createDataFrame([(i, "function") for i in ids], "qualified_name string, kind string")
    edges = spark.createDataFrame([(*e, "CALLS", 1.0 + k % 3) for k, e in enumerate(links)], "source string, target string, type string, weight double")
    nodes, weighed = A.community_graph(symbols, edges)
    near = {}
    for s, t, w in weighed.collect():
        near.setdefault(s, []).append((t, w))
        near.setdefault(t, []).append((s, w))
    labels = {i: i for i in ids}
    for _ in range(8):
        for r in sorted(nodes.collect(), key=lambda r: (-r.degree, r.id)):
            if r.id in near:
                heard = {labels[r.id]: 100_000}
                for j, w in near[r.id]:
                    heard[labels[j]] = heard.get(labels[j], 0) + w
                labels[r.id] = min(heard, key=lambda x: (-heard[x], x))
    for together in (10, 500_000):
        got = A.communities_exact(symbols, edges, together=together)
        assert {r.id: r.label for r in got.collect()} == labels


def test_call_edges_send_no_side_of_a_join_to_all(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["call_edges"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_line_search_makes_no_row_or_array_of_a_token(spark, monkeypatch):
    from codeloom.operators import retrieval as R

    draw, held, stored = random.Random(7), {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, label: held.setdefault(label, stored(df, label)))
    parts = [*"abXZ019_ .,-/'äÖßéİΣ٣\t$", "Http", "URL", "getX", "foo_bar", "http", "anea", "Thing", "thing_x", "a" * 79, "b" * 41]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(16))) for _ in range(3000)]
    lines = spark.createDataFrame([(f"f{k % 900}.ts", k % 11, t) for k, t in enumerate(texts)], "path string, line int, text string")  # some places come twice
    tokens = R.tokenized(lines)
    for query in ("httpThing anea_x", "aa foobar b", "!"):
        held.clear()
        got = [tuple(r) for r in R.search_lines(lines, query, limit=500).collect()]
        assert got == [tuple(r) for r in R.search_index(R.line_index(tokens), R.index_totals(tokens), query, limit=500).collect()]
        assert all("array" not in kind for df in held.values() for _, kind in df.dtypes) and sum(df.count() for df in held.values()) < 3 * len(texts)
    assert bool(got) == (query != "!")


def test_searched_lines_are_dealt_to_many_tasks(spark, monkeypatch):
    import __spark_entry__
    from codeloom.operators import retrieval as R

    parts, stored = {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, label: (parts.setdefault(label, df.rdd.getNumPartitions()), stored(df, label))[1])
    for name in ("bm25_lines", "context_pack"):
        parts.clear()
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert parts["line-counts"] == 4


def test_symbol_searches_read_each_text_once(spark):
    from codeloom.operators import retrieval as R

    symbols = spark.createDataFrame([("a", "saveOrder", "function", "a.ts", 1, 2, 1, "f()", None)], "qualified_name string, name string, kind string, file_path string, start_line int, end_line int, exported int, signature string, metadata string")
    files = spark.createDataFrame([("a.ts", "save orders\nof users")], "path string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = "regexp_extract_all(lower(regexp_replace(regexp_replace(concat_ws("
    assert plan(R.semantic_search(symbols, files, "save order")).count(once) == 1
    index = plan(R.vector_index(symbols, files))
    assert index.count(once) == 1 and "Aggregate" not in index and "Generate" not in index  # no token is a row


def test_hashed_vectors_of_batches_and_repeated_keys(spark):
    import math
    from collections import Counter, defaultdict

    from codeloom.operators import terms as T

    def hashed(token):
        h = 2166136261
        for c in token:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h - 2**32 if h >= 2**31 else h

    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefgh12") for _ in range(draw.randrange(1, 12))) for _ in range(120)]
    rows = [(f"k{draw.randrange(60):02}" if k % 3 else f"own{k}", k, draw.choices(words, k=draw.randrange(12))) for k in range(300)] + [("none", 300, []), ("null", 301, None), (None, 302, ["abc"])]
    of, want = defaultdict(Counter), {}
    for key, _, tokens in rows:
        of[key].update(tokens or [])
    for key, n, tokens in rows:
        sums = defaultdict(float)
        for t, c in of[key].items():
            sums[abs(hashed(t)) % 32] += (-1 if hashed(t) % 2 else 1) * (1 + math.log(c)) * (1.15 if len(t) >= 8 else 1)
        weights = [(b, round(w, 6)) for b, w in sorted(sums.items()) if abs(round(w, 6)) > 0.000001]
        if key and weights:
            want[n] = (key, sorted(set(tokens or [])), weights, round(math.sqrt(sum(w * w for _, w in weights)), 6))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # rows of a key come in several batches
    try:
        got = T.hashed_vectors(spark.createDataFrame(rows, "key string, n long, tokens array<string>"), "key", "tokens", 32).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {r.n: (r.key, r.tokens, [tuple(w) for w in r.weights], r.magnitude) for r in got} == want
