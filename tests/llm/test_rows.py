"""Null and repeated ids, empty tables and clashing columns, for every operator on documents and the pipeline."""

import pytest

import corpus_pipeline
from codeloom.llm import decontaminate, language_model, near_duplicates, packing, pii, quality, substring_dedup, token_counts, url_filter, warc

BODY = "the mail of someone else is a.b@c.example.org and nothing more stands here but words of this very line number"
TEXTS = [f"{BODY} one", f"{BODY} one two", "short", None, "", f"{BODY} one", "another text with many other words in it than those before, call +1 555 555 0100 now or never again please"]
IDS = [5, 5, None, None, 6, 5, 7]
EXTRA = ("key", "shard", "rid", "row", "term", "digest", "class", "n", "bands", "base", "spans", "part", "bin", "_votes", "words", "item_id", "piece", "offset", "kept")
ITEMS = "item_id long, text string, words string, window_id long"

OPERATORS = {
    "op1": lambda d, i: substring_dedup.remove_repeats(d),
    "op2": lambda d, i: packing.best_fit_packing(packing.pieces_of(d)),
    "op3": lambda d, i: pii.digest(pii.detect(d)),
    "op5": lambda d, i: token_counts.token_counts(d),
    "op6": lambda d, i: near_duplicates.near_duplicate_classes(d).drop("class"),
    "op7": lambda d, i: decontaminate.decontaminate(d, i),
    "op8": lambda d, i: quality.quality(quality.features(d)),
    "op9": lambda d, i: language_model.score(d),
}


def rows_of(spark, extra):
    names = ["doc_id long", "text string", *(f"`{x}` string" for x in (EXTRA if extra else ()))]
    return spark.createDataFrame([(i, t, *("x" for _ in (EXTRA if extra else ()))) for i, t in zip(IDS, TEXTS)], ", ".join(names)).repartition(2)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "nothing more stands here but words of this very line", "x", 3)], ITEMS)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, items, name):
    op = OPERATORS[name]
    plain = sorted(map(repr, op(rows_of(spark, False), items).collect()))
    assert sorted(map(repr, op(rows_of(spark, True), items).collect())) == plain  # clashing columns play no part
    got = op(rows_of(spark, False), items).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, IDS))  # a row each, ids as they were
    assert op(rows_of(spark, False).where("false"), items).count() == 0


def test_contaminated_whatever_the_id(spark, items):
    docs = spark.createDataFrame([(None, TEXTS[0]), (1, TEXTS[0]), (1, "clean")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit > 0) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == [("1", False), ("1", True), ("None", True)]
    assert [r.text for r in decontaminate.clean(docs, items).collect()] == ["clean"]
    assert decontaminate.decontaminate(docs, items.where("false")).where("contaminated").isEmpty()


def test_masked_by_row(spark):
    docs = rows_of(spark, True)
    got = pii.masked(docs).collect()
    assert sorted(r.text or "" for r in got) == sorted((t or "").replace("a.b@c.example.org", "<EMAIL>").replace("+1 555 555 0100", "<PHONE>") for t in TEXTS)
    assert pii.masked(docs).columns == docs.columns and sum(r.text is None for r in got) == 1


def test_near_duplicates_of_repeated_ids(spark):
    docs = spark.createDataFrame([(5, TEXTS[0]), (5, TEXTS[6]), (6, TEXTS[6] + " today"), (7, TEXTS[1]), (None, TEXTS[1])], "doc_id long, text string")
    got = {(r.doc_id, r.digest.hex()[:6]): (r["class"], r.class_id) for r in near_duplicates.near_duplicate_classes(docs).collect()}
    assert len({c for c, _ in got.values()}) == 2 and {i for _, i in got.values()} == {5}
    kept = near_duplicates.first_of_each(docs).collect()
    assert sorted(r.text for r in kept) == sorted([TEXTS[0], TEXTS[6]])


def test_language_model_of_repeated_ids(spark):
    docs = spark.createDataFrame([(2, "a b"), (2, "c d e"), (None, "f"), (3, "a b c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens, r.held_out) for r in language_model.score(docs).collect())
    assert [x[:2] for x in got] == [("2", 3), ("2", 4), ("3", 4), ("None", 2)] and got[-1][2]
    assert [r.score for r in language_model.score(docs).orderBy("n_tokens").collect()] == [r.score for r in language_model.score(docs).orderBy("n_tokens").collect()]


def test_pipeline_rows(spark, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    good = "It was a long and quiet day in the town, and the people who lived there went about what they had to do without much talk. " * 1
    texts = [good + f"Number {i} of the houses had a garden with {i} trees in it, as the old map of that street shows to anyone who asks for it." for i in ("one", "four", "nine")]
    rows = [(None, texts[0], "a"), (1, texts[1] + " x" * 3, "b"), (1, texts[2] + " A whole other ending, with many words that stand nowhere else in this small table of rows.", "c"), (2, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 1}
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    items.write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "k", "k"), (1, "http://a.com/x", "k", "k"), (None, None, None, "k")], "page_id long, url string, html string, keys string")
    assert url_filter.filter_urls(pages).count() == 3 and url_filter.filter_urls(pages.where("false")).count() == 0
    assert warc.derivatives(warc.responses(pages)).count() == 6


def test_broken_warc():
    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"HTTP/1.1 200 OK\r\n\r\nhello")
    bad = whole.replace(b"Content-Length: 24", b"Content-Length: -3")
    assert bad != whole
    for first in (bad, whole.replace(b"Content-Length: 24", b"Content-Length: many"), whole):
        got = list(warc.parse_records(first + whole))
        assert len(got) == 2 and got[1][1].endswith(b"hello") and got[0][1].startswith(b"HTTP")
    import gzip

    packed = gzip.compress(whole) + gzip.compress(whole)
    assert len(list(warc.parse_records(packed))) == 2
    assert len(list(warc.parse_records(packed[: len(gzip.compress(whole)) + 10]))) == 1
