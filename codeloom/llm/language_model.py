"""Operator 9: interpolated modified Kneser-Ney model of order 3 (or 2), counted and scored in shards.

Every token is an event (two words before it, word).  Events go to the shard of the word
just before, v.  All that the model asks of (u, v, w) has v in it: counts and contexts of three
words, and the continuation counts and contexts of two; so one shuffle serves all orders.  A very
frequent v is spread over as many shards as its share asks for, by w.  In five steps over packed messages:

1. documents -> events at their shards;
2. each shard counts its training n-grams and tells word buckets what it holds a part of: continuation
   counts of its words, statistics of its spread contexts (v) and (u, v);
3. buckets add these up and answer every asking shard;
4. the driver gets a few numbers from each shard and bucket (counts of counts, totals) and derives the discounts;
5. each shard stores what it was told as sorted hash arrays in a temporary file, maps them into
   memory, scores its events and sends sums by document; these are added up.

Step 5 reads the same shuffle files as step 2.

Nothing stands before the start of a text: pairs that begin there count as often as they occur, and the first
word is scored from them alone.

Edge cases: null and empty texts are the end token alone; equal rows train twice and are each scored once;
rows that share a doc_id are documents of their own, a null id counts as the empty text; ids are whole numbers; an empty table gives no rows;
unknown words share the model's unseen mass; other columns play no part.
"""

from __future__ import annotations

import itertools
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs, shingles
from .common import shards_for, stored, table

RUN_BYTES = 7_000_000
SHARD_BYTES = 17_000_000  # text whose events a shard gets
START, END = np.uint64(1), np.uint64(2)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _hashes(words) -> np.ndarray:
    import xxhash

    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)
    out[out < 3] += np.uint64(3)
    return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted array, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    with np.errstate(over="ignore"):
        return shingles.mix(a * np.uint64(0x9E3779B97F4A7C15) + shingles.mix(b))


def _spread(v: np.ndarray, w: np.ndarray, hot: np.ndarray, pieces: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each event; the events of a spread word before lie in that many shards, dealt by the word."""
    out = shingles.mix(v) % np.uint64(shards)
    at, found = _find(hot, v)
    out[found] = (out[found] + shingles.mix(w[found]) % pieces[at[found]].astype(np.uint64)) % np.uint64(shards)
    return out.astype(np.int64)


def _events(rows_: np.ndarray, ids: list, texts: list[bytes], hot: np.ndarray, pieces: np.ndarray, shards: int, order: int):
    """(shard, message) of a run of documents (row numbers, ids, texts): sorted hashes of contexts and words, and events sorted by both; and each row's id, to the row's own shard."""
    number = defaultdict(itertools.count(2).__next__)  # 0 start, 1 end
    rows = [np.fromiter(map(number.__getitem__, t.translate(_LOWER).split()), np.int32) for t in texts]
    known = np.concatenate([np.array([START, END]), _hashes(number)])
    del number
    sizes = np.array([len(r) for r in rows]) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    w = np.empty(len(doc), np.int32)
    ends = np.cumsum(sizes)
    inside = np.ones(len(doc), bool)
    inside[ends - 1] = False
    w[inside], w[~inside] = np.concatenate(rows), 1
    del rows, inside
    v, u = np.zeros_like(w), np.zeros_like(w) if order > 2 else None
    v[1:] = w[:-1]
    v[ends - sizes] = 0
    if order > 2:
        u[1:] = v[:-1]
        u[ends - sizes] = 0
    shard = _spread(known[v], known[w], hot, pieces, shards)
    rank = np.argsort(known, kind="stable")
    place = np.empty(len(rank), np.int32)
    place[rank] = np.arange(len(rank), dtype=np.int32)
    v, w, ordered = place[v], place[w], known[rank]
    few = len(known) < 2**24 and shards < 2**15
    at = np.argsort((shard << 48) | (v.astype(np.int64) << 24) | w) if few else np.lexsort((w, v, shard))
    v, w, doc, shard = v[at], w[at], doc[at], shard[at]
    u = place[u[at]] if order > 2 else None
    edges = blobs.groups(shard)
    training = np.array([not held_out(i) for i in ids], np.uint8)
    first = lambda h: np.diff(h, prepend=np.uint64(0))
    for a, b in zip(edges[:-1], edges[1:]):
        vs, v_of = np.unique(v[a:b], return_inverse=True)
        ws, both = np.unique(np.concatenate([w[a:b], u[a:b]]) if order > 2 else w[a:b], return_inverse=True)
        docs, d_of = np.unique(doc[a:b], return_inverse=True)
        word = blobs.small(both[: b - a])
        yield int(shard[a]), blobs.pack(np.diff(rows_[docs], prepend=0), training[docs], first(ordered[vs]), blobs.small(np.bincount(v_of)), first(ordered[ws]), np.diff(word, prepend=word.dtype.type(0)), blobs.small(d_of), blobs.small(both[b - a :]))
    home = (shingles.mix(rows_.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    known_id, none = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8)
    for h in np.unique(home).tolist():
        at = np.flatnonzero(home == h)
        yield h, blobs.pack(np.diff(rows_[at], prepend=0), known_id[at], none[at])


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the place of each key among them in 32 bits."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], place


class Shard:
    """A shard's events, merged from its messages; ``named`` has the messages with rows' ids.

    ``pairs`` are distinct (v, w), ``triples`` distinct (pair, u), ``before`` distinct (v, u); where the order is 2, triples are pairs and there is no ``before``.
    """

    def __init__(self, messages: list[bytes], order: int):
        messages.sort()  # in one order, so that sums are the same each time
        parts = [blobs.unpack(m) for m in messages]
        messages.clear()  # an executor holds several shards
        self.named = [p for p in parts if len(p) == 3]
        parts = [p for p in parts if len(p) > 3]
        vs = [np.cumsum(p[2], dtype=np.uint64) for p in parts]
        ws = [np.cumsum(p[4], dtype=np.uint64) for p in parts]
        empty = np.zeros(0, np.uint64)
        self.contexts, self.words = (np.unique(np.concatenate(x)) if x else empty for x in (vs, ws))
        rows = [np.cumsum(p[0]) for p in parts]
        self.docs = np.unique(np.concatenate(rows)) if parts else np.zeros(0, np.int64)
        cat = lambda xs, t: np.concatenate(xs).astype(t, copy=False) if xs else np.zeros(0, t)
        # places within a shard: 32 bits are enough, and an executor holds several shards
        place = lambda known, h: np.searchsorted(known, h).astype(np.int32)
        ws = [place(self.words, h) for h in ws]
        v = cat([np.repeat(place(self.contexts, h), p[3].astype(np.int64)) for h, p in zip(vs, parts)], np.int32)
        w = cat([h[np.cumsum(p[5], dtype=p[5].dtype)] for h, p in zip(ws, parts)], np.int32)
        u = cat([h[p[7]] for h, p in zip(ws, parts)], np.int32) if order > 2 else None
        self.doc = cat([place(self.docs, r)[p[6]] for r, p in zip(rows, parts)], np.int32)
        training = cat([p[1][p[6]] for p in parts], bool)
        del parts, vs, ws
        pairs, pair = _classes((v.astype(np.int64) << 32) | w)
        del v, w
        self.pair_v, self.pair_w = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
        del pairs
        if order > 2:
            triples, self.triple = _classes((pair.astype(np.int64) << 32) | u)
            self.triple_pair = (triples >> 32).astype(np.int32)
            before, self.triple_before = _classes((self.pair_v[self.triple_pair].astype(np.int64) << 32) | triples.astype(np.int32))
            self.before_v, self.before_u = (before >> 32).astype(np.int32), before.astype(np.int32)
            del triples, before
        else:
            self.triple, self.triple_pair = pair, np.arange(len(self.pair_v), dtype=np.int32)
        del pair, u
        self.count = np.bincount(self.triple[training], minlength=len(self.triple_pair)).astype(np.int32)
        size = len(self.pair_v)
        self.raw = np.bincount(self.triple_pair, weights=self.count, minlength=size).astype(np.int64)
        self.plain = (self.contexts == START)[self.pair_v] if order > 2 else np.ones(size, bool)  # nothing longer is known of these pairs
        self.adjusted = np.where(self.plain, self.raw, np.bincount(self.triple_pair[self.count > 0], minlength=size)) if order > 2 else self.raw

    @staticmethod
    def _of(group: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
        seen = lambda where: np.bincount(group[where], minlength=n)
        return [np.bincount(group, weights=counts, minlength=n).astype(np.int64), seen(counts == 1), seen(counts == 2), seen(counts > 2)]

    def statistics(self) -> np.ndarray:
        """For each context (v): training count; sum of its pairs' adjusted counts, and pairs whose such count is 1, 2, more."""
        n = len(self.contexts)
        return np.column_stack([np.bincount(self.pair_v, weights=self.raw, minlength=n).astype(np.int64), *self._of(self.pair_v, self.adjusted, n)])

    def longer_statistics(self) -> np.ndarray:
        """For each context (u, v): training count, and words seen after it once, twice, more often."""
        return np.column_stack(self._of(self.triple_before, self.count, len(self.before_v)))

    def before_hashes(self) -> np.ndarray:
        return _joined(self.contexts[self.before_v], self.words[self.before_u])

    def continuations(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that follow something, and how many contexts in training they follow."""
        n = len(self.words)
        asked = np.flatnonzero(np.bincount(self.pair_w, minlength=n))
        return asked, np.bincount(self.pair_w[self.raw > 0], minlength=n)[asked]


WIDTHS = (1, 5, 4)  # columns of what shards and buckets tell of words, contexts (v) and contexts (u, v)


def _tables(shard: Shard, hot: np.ndarray, order: int):
    """What a shard holds a part of, as (hashes, columns) for each width."""
    asked, continued = shard.continuations()
    is_hot = _find(hot, shard.contexts)[1]
    yield shard.words[asked], continued.reshape(-1, 1)
    yield shard.contexts[is_hot], shard.statistics()[is_hot]
    if order > 2:
        at = np.flatnonzero((is_hot & (shard.contexts != START))[shard.before_v])
        yield shard.before_hashes()[at], shard.longer_statistics()[at]
    else:
        yield np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)


def _packed(tables) -> bytes:
    out = []
    for hashes, columns in tables:
        out += [np.diff(hashes, prepend=np.uint64(0)), *(blobs.small(c) for c in columns.T)]
    return blobs.pack(*out)


def _unpacked(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    arrays, at, out = blobs.unpack(blob), 0, []
    for width in WIDTHS:
        columns = arrays[at + 1 : at + 1 + width]
        out.append((np.cumsum(arrays[at], dtype=np.uint64), np.column_stack([c.astype(np.int64) for c in columns])))
        at += 1 + width
    return out


def _mapped(f, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash arrays at the end of a file, mapped into memory: hashes, and a row of 32-bit counts for each."""
    hashes, columns = np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found])
    order, at, width = np.argsort(hashes), f.tell(), columns.shape[1]
    if not len(order):
        return hashes, columns
    f.write(hashes[order].tobytes() + columns[order].astype(np.uint32).tobytes() + b"\0" * (-4 * len(order) * width % 8))
    f.flush()
    return np.memmap(f.name, np.uint64, "r", at, (len(order),)), np.memmap(f.name, np.uint32, "r", at + 8 * len(order), (len(order), width))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))])


def _of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _frequent(rows: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the contexts to spread, and the number of shards for each: the start, and every word with 1/(4*shards) of all tokens.

    A run of documents reports the words that have half that share of its own tokens.  What runs leave out of a word
    is then less than half the share, so the words sought are all among those reported that often, 8 for each shard at most.
    A word gets a shard for each 1/(4*shards) of all tokens, and one more.
    """

    def count(batches):
        seen, size, texts = Counter(), 0, 0
        for batch in batches:
            for t in batch.column(1).to_pylist():
                seen.update(t.translate(_LOWER).split())
                size += len(t)
                texts += 1
                if size >= RUN_BYTES:
                    yield report(seen, texts)
                    seen, size, texts = Counter(), 0, 0
        if texts:
            yield report(seen, texts)

    def report(seen, texts):
        total = sum(seen.values())
        found = [(x, n) for x, n in seen.items() if n >= total / (8 * shards)]
        hashes = np.append(_hashes([x for x, _ in found]), np.array([START, 0], np.uint64)).view(np.int64)  # 0: all tokens of the run
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([*(n for _, n in found), texts, total], pa.int64())], ["word", "n"])

    reported = stored(rows.mapInArrow(count, "word long, n long"), "frequent-words")
    total = reported.where("word = 0").agg(F.sum("n")).first()[0] or 1
    least = F.col("n") >= max(2, total / (8 * shards))
    found = reported.where("word <> 0").groupBy("word").agg(F.sum("n").alias("n")).where(least | (F.col("word") == int(START))).collect()
    hot, n = np.array([r.word for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(hot)
    return hot[order], np.minimum(shards, -(-4 * shards * n[order] // total) + 1)


def score(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document, by a model of ``order`` 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    shards = shards_for(rows, SHARD_BYTES)

    hot, pieces = _frequent(rows, shards)

    def send(batches):
        for batch in batches:
            ids, texts, numbers, at, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(), 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= RUN_BYTES or k == len(texts) - 1:
                    found = list(_events(numbers[at : k + 1], ids[at : k + 1], texts[at : k + 1], hot, pieces, shards, order))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["key", "blob"])
                    at, size = k + 1, 0

    events = blobs.sent(rows.mapInArrow(send, "key int, blob binary"), shards)

    def ask(index, pairs):
        """Step 2: what this shard holds a part of, to every bucket, and this shard's numbers."""
        shard = Shard([b for _, b in pairs], order)
        own, starts = shard.statistics()[:, 0], int(shard.raw[(shard.contexts == START)[shard.pair_v]].sum())
        yield 0, ("shard", _of_counts(shard.adjusted), _of_counts(shard.count[~shard.plain[shard.triple_pair]]), int(own.sum()), starts, int((own[~_find(hot, shard.contexts)[1]] > 0).sum()))
        tables = []
        for hashes, columns in _tables(shard, hot, order):
            bucket = (shingles.mix(hashes ^ np.uint64(0xABCDEF)) % np.uint64(shards)).astype(np.int64)
            at = np.lexsort((hashes, bucket))
            tables.append((hashes[at], columns[at], np.searchsorted(bucket[at], np.arange(shards + 1))))
        del shard
        for k in range(shards):
            part = [(h[e[k] : e[k + 1]], c[e[k] : e[k + 1]]) for h, c, e in tables]
            if any(len(h) for h, _ in part):
                yield k, (index, _packed(part))

    asked = blobs.resent(events.mapPartitionsWithIndex(ask), shards)

    def answer(pairs):
        """Step 3: add up, answer in the same order."""
        got = []
        for _, what in pairs:
            if what[0] == "shard":
                yield 0, what
            else:
                got.append((what[0], _unpacked(what[1])))
        if not got:
            return
        sums_, places = [], []
        for j, width in enumerate(WIDTHS):
            known = np.unique(np.concatenate([t[j][0] for _, t in got]))
            total = np.zeros((len(known), width), np.int64)
            places.append([np.searchsorted(known, t[j][0]) for _, t in got])
            for at, (_, t) in zip(places[-1], got):
                total[at] += t[j][1]
            sums_.append((known, total))
        continued, contexts = sums_[0][1][:, 0], sums_[1]
        yield 0, ("bucket", _of_counts(continued), int(continued.sum()), int((continued > 2).sum()), int((contexts[1][contexts[0] != START, 0] > 0).sum()))
        for k, (shard, t) in enumerate(got):
            yield shard, (1, _packed([(t[j][0], sums_[j][1][places[j][k]]) for j in range(3)]))

    answered = blobs.resent(asked.mapPartitions(answer), shards)
    told = answered.filter(lambda x: isinstance(x[1][0], str)).values().collect()  # step 4: a few numbers a shard
    if not told:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    of_shards, of_buckets = [x for x in told if x[0] == "shard"], [x for x in told if x[0] == "bucket"]
    documents_trained = sum(x[4] for x in of_shards)
    n_tokens = sum(x[3] for x in of_shards)  # as a context each word counts once, and the start stands for the end
    n_types = sum(x[5] for x in of_shards) + sum(x[4] for x in of_buckets) + (documents_trained > 0)
    d2, d3 = (discounts(*sum(x[k] for x in of_shards).tolist()) for k in (1, 2))
    c1 = sum((x[1] for x in of_buckets), np.zeros(4, np.int64))
    d1 = discounts(*c1.tolist())
    total1, many = sum(x[2] for x in of_buckets), sum(x[3] for x in of_buckets)
    spare = (d1[1] * c1[0] + d1[2] * c1[1] + d1[3] * many) / total1 if total1 else 1.0
    uniform = 1 / (n_types + 1)  # one more for what was never seen
    base_of = lambda c: np.log10((c + 0.1) / (n_tokens + 0.1 * (n_types + 1)))

    def mixed(counts, context, stats, d, lower):
        """Discounted share of each count within its context, and the context's spare mass times the lower order."""
        whole = np.maximum(stats[:, 0], 1)
        back = np.where(stats[:, 0] > 0, (stats[:, 1:] @ d[1:]) / whole, 1.0)
        return np.maximum(counts - d[np.minimum(counts, 3)], 0) / whole[context] + back[context] * lower

    def sums(index, pairs):
        """Step 5: scores of this shard's events, by document; and the ids of this shard's rows, which stay here."""
        messages, tables = [], []
        for _, what in pairs:
            if isinstance(what, bytes):
                messages.append(what)
            elif not isinstance(what[0], str):
                tables.append(_unpacked(what[1]))
        if not messages:
            return
        shard = Shard(messages, order)
        del messages
        for p in shard.named:
            yield index, blobs.pack(*p)
        if not len(shard.docs):
            return
        with tempfile.NamedTemporaryFile() as f:
            (words, continued), (contexts, counted), (longer, longer_counted) = (_mapped(f, [t[j] for t in tables]) for j in range(3))
            del tables
        k = continued[np.minimum(np.searchsorted(words, shard.words), len(words) - 1), 0].astype(np.int64)  # words that follow nothing are not read below
        p1 = (np.maximum(k - d1[np.minimum(k, 3)], 0) / total1 if total1 else np.zeros(len(k))) + spare * uniform
        stats = shard.statistics()
        at, told_of = _find(contexts, shard.contexts)
        stats[told_of] = counted[at[told_of]]
        p2 = mixed(shard.adjusted, shard.pair_v, stats[:, 1:], d2, p1[shard.pair_w])
        p = p2[shard.triple_pair]
        if order > 2:
            longer_stats = shard.longer_statistics()
            at, told_of_longer = _find(longer, shard.before_hashes())
            told_of_longer &= told_of[shard.before_v]
            longer_stats[told_of_longer] = longer_counted[at[told_of_longer]]
            p = np.where(shard.plain[shard.triple_pair], p, mixed(shard.count, shard.triple_before, longer_stats, d3, p))
        size = len(shard.docs)
        score_ = np.bincount(shard.doc, weights=np.log10(p)[shard.triple], minlength=size)
        # each word is the context of one event: its unigram score is added there
        real, seen = shard.contexts != START, stats[:, 0] > 0
        v = shard.pair_v[shard.triple_pair][shard.triple]
        base = np.bincount(shard.doc, weights=np.where(real, base_of(stats[:, 0]), 0.0)[v], minlength=size)
        n_tok = np.bincount(shard.doc, minlength=size)
        n_known = np.bincount(shard.doc, weights=(real & seen)[v], minlength=size).astype(np.int64)
        starts = np.bincount(shard.doc, weights=(~real)[v], minlength=size).astype(np.int64)
        bucket = (shingles.mix(shard.docs.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = blobs.groups(bucket[by_bucket])
        for a, b in zip(edges[:-1], edges[1:]):
            i = by_bucket[a:b]
            yield int(bucket[i[0]]), blobs.pack(np.array([index]), np.diff(shard.docs[i], prepend=0), score_[i], base[i], blobs.small(n_tok[i]), blobs.small(n_known[i]), blobs.small(starts[i]))

    added = blobs.resent(blobs.together(answered, events).mapPartitionsWithIndex(sums), shards)

    def rows_of(pairs):
        found = [blobs.unpack(b) for _, b in pairs]
        parts = sorted((p for p in found if len(p) > 3), key=lambda p: int(p[0][0]))
        if not parts:
            return
        names = {d: (None if none else i) for p in found if len(p) == 3 for d, i, none in zip(np.cumsum(p[0]).tolist(), p[1].tolist(), p[2].tolist())}
        ids = [np.cumsum(p[1]) for p in parts]
        docs = np.unique(np.concatenate(ids))
        total = np.zeros((5, len(docs)))
        for i, p in zip(ids, parts):
            at = np.searchsorted(docs, i)
            for j in range(5):
                total[j, at] += p[j + 2]
        ends = total[4]
        known = total[3] + ends * (documents_trained > 0)
        base = total[1] + ends * base_of(documents_trained)
        for d, s, b, n, k in zip(docs.tolist(), total[0].tolist(), base.tolist(), total[2].tolist(), known.tolist()):
            yield names[d], held_out(names[d]), int(n), int(k), n_tokens, b, s

    return spark.createDataFrame(added.mapPartitions(rows_of), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", verifySchema=False)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 2: order 3 exceeds the memory and disk that an executor has on large tables (figures in the README)."""
    return score(table(spark, sf_dir, "documents"), order=2)


QUERIES = {"op9_kneser_ney": op9_kneser_ney}
ORACLE_SQL: dict[str, str] = {}
