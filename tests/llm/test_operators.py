"""Edge cases of the corpus operators against brute force: nulls, empty and repeated texts, ties, clashing columns, empty tables."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest

from codeloom.llm import decontaminate, language_model, near_duplicates, packing, pii, quality, substring_dedup, token_counts, tokens, url_filter

LONG = " ".join(f"word{i} and the other thing" for i in range(60))
TEXTS = [None, "", "one", LONG, LONG, LONG + " extra", "x " * 3000, "mail a.b@c.example.org or +1 (555) 555-0100 from 10.0.0.1\nmail a.b@c.example.org", "<|endoftext|> the  the\n\t end ", "été " + LONG[:400]]
ROWS = [(i, t, "en", "label", 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, key string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, none):
    tok = tokens.load(tokens.public_path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs))
    for i, t in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)))
    assert token_counts.token_counts(none).count() == 0


def test_packing_round_trip(docs, none):
    tok = tokens.load(tokens.public_path("word_bpe_49k.json"))
    rows = packing.best_fit_packing(packing.pieces_of(docs, capacity=64), capacity=64, group_pieces=7).collect()
    assert sum(r.length for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False)) + 1 for t in TEXTS)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(packing.pieces_of(none)).count() == 0


def test_personal_data(docs, none):
    got = by_id(pii.digest(pii.detect(docs)))
    assert (got[7].n_email, got[7].n_phone, got[7].n_ip) == (2, 1, 1)
    assert got[7].spans.startswith("email:5:22,phone:26:43")
    assert all(got[i].spans == "" for i in (0, 1, 2))
    assert pii.detect(none).count() == 0
    assert "<EMAIL>" in by_id(pii.masked(docs))[7].text


def test_near_duplicates(docs, none):
    got = {i: r.class_id for i, r in by_id(near_duplicates.near_duplicate_classes(docs)).items()}
    assert got[0] == got[1] == 0 and got[3] == got[4] == got[5] == 3 and got[2] == 2 and got[6] == 6
    assert near_duplicates.near_duplicate_classes(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[20:32])), (2, "ONE"), (3, None)], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, items))
    assert (got[2].n_hit, got[2].n_items) == (1, 1) and got[3].n_hit == 12 and not got[0].contaminated
    assert decontaminate.decontaminate(none, items).count() == 0


def test_quality(docs, none):
    got = by_id(quality.quality(quality.features(docs)))
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept and got[6].base_failed
    assert quality.quality(quality.features(none)).count() == 0


def test_substrings(docs, none):
    got, seen = by_id(substring_dedup.remove_repeats(docs)), {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if seen.get(b[j : j + 50], i) < i:
                gone[j : j + 50] = b"\1" * 50
        for j in range(len(b) - 49):
            seen.setdefault(b[j : j + 50], i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substrings_repeated_in_a_document(spark):
    """What goes next to a document's first copy of a passage stays next to its second one."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    texts = []
    for _ in range(10):
        line, p, r = some(200), some(60), some(60)
        texts += [some(80) + line[-40:] + p, some(80) + line + p + some(80) + line + r]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), texts[1]), (len(texts), texts[3][:300])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    seen, want = {}, []
    for i, t in rows:
        for j in range(len(t) - 49):
            seen[t[j : j + 50]] = min(seen.get(t[j : j + 50], i), i)
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if seen[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = "".join(x for x, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)


def test_language_model(docs, none):
    got = by_id(language_model.score(docs))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "")) for i, t in enumerate(TEXTS)}
    assert all(got[i].n_tokens == len(w) + 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) for i, w in words.items())
    assert all(r.score <= 0 for r in got.values())
    assert language_model.score(none).count() == 0


def test_frequent_words_behind_the_first_rows(spark):
    """A word that fills the end of the table is spread over shards like one at its beginning."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 2500 THEN concat('a', id, ' b', id) ELSE 'Hot x hot y' END AS text").coalesce(2)
    frequent, pieces = language_model._frequent(rows.selectExpr("doc_id", "CAST(text AS BINARY) AS text"), 4)
    assert language_model._hashes([b"hot"])[0] in frequent and language_model._hashes([b"a1"])[0] not in frequent
    sent = collections.Counter(language_model._spread(np.repeat(language_model._hashes([b"hot"]), 200), language_model._hashes([b"w%d" % i for i in range(200)]), frequent, pieces, 4).tolist())
    assert len(sent) == 4


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_by_formula(spark, order):
    """Scores of a small corpus against modified Kneser-Ney in plain Python."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["hot"] * 6 + list("abcdefghijklmnopqrst"), k=rng.randint(0, 25))) for _ in range(120)]
    got = by_id(language_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=order))
    runs = {i: ["<s>", *t.split(), "</s>"] for i, t in enumerate(texts)}
    trained = [r for i, r in runs.items() if zlib.crc32(str(i).encode()) % 10]
    count = {n: collections.Counter(tuple(r[k : k + n]) for r in trained for k in range(len(r) - n + 1)) for n in (2, 3)}
    lower = [collections.Counter(g[1:] for g in count[n]) for n in (2, 3)]  # distinct words before
    tables = [lower[0], count[2]] if order == 2 else [lower[0], lower[1] + collections.Counter({g: c for g, c in count[2].items() if g[0] == "<s>"}), count[3]]

    def discount(counts):
        n = [sum(1 for c in counts if c == k) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0.0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]

    cuts = [discount(t.values()) for t in tables]
    follow = [collections.defaultdict(list) for _ in tables]
    for t, f in zip(tables, follow):
        for g, c in t.items():
            f[g[:-1]].append(c)
    types = len(lower[0])

    def p(gram):
        if not gram:
            return 1 / (types + 1)
        n, below = len(gram) - 1, p(gram[1:])
        after = follow[n][gram[:-1]]
        if not after:
            return below
        c, d = tables[n][gram], cuts[n]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in after) * below) / sum(after)

    for i, r in runs.items():
        want = sum(math.log10(p(tuple(r[max(0, k - order + 1) : k + 1]))) for k in range(1, len(r)))
        assert got[i].score == pytest.approx(want, abs=1e-9)


def test_urls(spark):
    urls = [None, "no-scheme", "http://EXAMPLE.com/en/1?x", "https://www.example.com/en/2", "http://a.net/es/3", "http://a.net/de/4", "http://b.org", "http://com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == (None, "allow") and got[2] == ("example.com/en/", "block") and got[3] == ("www.example.com/en/", "allow")
    assert got[4] == ("net/es/", "block") and got[5] == (None, "block") and got[6] == (None, "allow") and got[7] == ("com/", "allow")
