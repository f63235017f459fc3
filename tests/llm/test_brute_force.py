"""Whole-table results on the smallest test tables against plain Python."""

import collections
import math
import os
import zlib

import numpy as np
import pytest

from codeloom.llm import decontaminate, language_model, near_duplicates, packing, pii, quality, tokens

from . import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_packing_equals_the_library(spark, documents):
    out = packing.op2_best_fit_packing(spark, SF).cache()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.collect()}
    tok, want = tokens.load(tokens.public_path("word_bpe_49k.json")), {}
    for d, t in documents:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[d, p // 2048] = (p, len(part), zlib.crc32(part.tobytes()))
    assert got == want
    used, bound = packing.certificate(out)
    assert used == bound
    places = collections.defaultdict(list)
    for r in out.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        ends = [0, *(a + n for a, n in sorted(x))]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|ENDOFTEXT|> x,", "don't can't, 'sing 'S It'S,", "É,é, É!", "İstanbul, ΑΣ ΑΣ, Σ", "abc—, def—", "１２,3 ab12cd, 9!", "ﬁne ﬁ, ǅ,", "a\x85b K K, ẞß,", "'ll, ' '' d,", "x" * 3000 + ",", ""])
def test_packing_encoder_of_odd_texts(text):
    encoder = packing.Encoder(tokens.public_path("word_bpe_49k.json"))
    for _ in range(2):
        assert encoder([text, "the, " + text])[0] == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_encode_whole_texts():
    encoder = packing.Encoder(tokens.public_path("byte_bpe_50k.json"))
    assert not encoder.by_word and encoder(["a  b\nc"])[0] == np.asarray(encoder.tokenizer.encode("a  b\nc", add_special_tokens=False).ids, "<u4").tobytes()


def test_base_spans(spark, documents):
    got = {r.doc_id: r for r in pii.op3_personal_data(spark, SF).collect()}
    for d, t in documents:
        spans = brute.base_spans(t)
        n = collections.Counter(k for k, *_ in spans)
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], brute.base_digest(spans))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))


def test_near_duplicate_classes(spark, documents):
    """All pairs: recall of links is 1, and no class differs."""
    got = {r.doc_id: r.class_id for r in near_duplicates.op6_bagminhash(spark, SF).collect()}
    classes, links = brute.near_classes([t for _, t in documents])
    assert links > 0 and got == {d: documents[c][0] for (d, _), c in zip(documents, classes)}


def test_quality_counts(spark, documents):
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for d, t in documents:
        want, r = brute.quality_counts(t), got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    bad = [got[d].kept for d, q in labels.items() if q == 0]
    good = [got[d].kept for d, q in labels.items() if q == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.95 * len(good)


def test_language_model_base(spark, documents):
    got = {r.doc_id: r for r in language_model.op9_kneser_ney(spark, SF).collect()}
    words = {d: [w.translate(brute.LOWER) for w in brute.WORD.findall(t or "")] + ["\n"] for d, t in documents}
    count = collections.Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    better = 0.0
    for d, ws in words.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        better += (r.score - r.base_score) * r.held_out
    assert better > 0  # on held-out documents


def test_proximity(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(list("abcdefghijklmnop"), 60))) for i in range(40)]
    items = [(0, "q1 a q2 b q3"), (1, "a b c")]
    texts += [(100, "x q3 x x q1 x q2 b a x"), (101, "q1 b a " + "x " * 30 + "q2 q3"), (102, "b x a y c")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity(docs, bench, within=8).collect()}
    split = {d: t.split() for d, t in texts}
    freq = collections.Counter(w for ws in split.values() for w in ws)
    want = set()
    for i, t in items:
        rare = sorted(set(t.split()), key=lambda w: (freq[w], w))[:3]
        want |= {(d, i) for d, ws in split.items() if any(set(rare) <= set(ws[k : k + 8]) for k in range(len(ws)))}
    assert got == want and (100, 0) in got and (101, 0) not in got
