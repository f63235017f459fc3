"""Operator 6: near duplicates by BagMinHash signatures of shingle multisets.

A shingle of weight w owns the points of a Poisson process on (0, w] x time.  Weights are
discretised to whole numbers and the levels are split hierarchically into bands (0,1], (1,2], (2,4], (4,8] ..;
a band of width b is one process of rate b whose points carry a level, and only points at levels
up to w count.  Each point falls on one of the signature's places; a place keeps its earliest point's time and identity.
Two texts agree at a place with probability equal to their weighted Jaccard similarity.  Processes are
followed only until every place has an earlier point, so a text costs about as many steps as it has shingles.

Signatures are banded; buckets with the same members count once.  A task holds whole buckets, or two blocks of
a larger one, together with the members' shingle multisets, and finds every link that joins its classes: pairs whose
signatures and bin sketches (estimates less than SURE standard deviations under the similarity) allow a link are
measured by exact multiset overlap, likeliest first, until their ends are in one class or have no pair left.  Two passes:

1. Buckets of the first bands, in blocks, join most of what belongs together; classes are connected components.
2. Buckets (of all bands) that still hold different classes.  A class of more than BLOCK texts meets
   its neighbours once, and not once for each bucket they share; all pairs of other classes meet, in blocks.

A large group of copies is never expanded into its pairs, and no link between classes is lost.

Edge cases: equal texts are one class whatever their length (null counts as empty); a text of fewer than five words is
one shingle; texts without words are near nothing but their equals; repeated rows and repeated ids (whatever their
texts) are rows of their own; a class is named by its least id that is not null, by null where it has none;
empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import dropped, parts_for, stored, table

PLACES, ROWS = 128, 4
FIRST_BANDS = 6  # bands of the first pass; the second takes all
SIMILARITY = 0.8
MOST = np.uint64(2**64 - 1)
RUN_BYTES = 1_000_000
BINS = 1024  # places of the sketch that pairs are judged by before they are measured
SURE = 4.5  # standard deviations that an estimate may lie under the similarity
BLOCK = 2048  # texts of a bucket that a task holds at once
BLOCK_ELEMENTS = 4_000_000  # and their elements


def signatures(doc: np.ndarray, key: np.ndarray, times: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` point identities for each text; zeros where a text has no shingles."""
    mix = shingles.mix
    best = np.full(n_docs * places, np.inf)
    owner = np.zeros(n_docs * places, np.uint64)
    # processes: for each shingle the bands of levels that begin below its weight
    n_bands = np.where(times > 1, np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(key)), n_bands)
    band = np.arange(len(which)) - np.repeat(np.cumsum(n_bands) - n_bands, n_bands)
    low = np.where(band == 0, 0, 2.0 ** (band - 1))
    width = np.where(band == 0, 1.0, low)
    d, weight = doc[which], times[which].astype(float)
    with np.errstate(over="ignore"):
        seed = mix(key[which] + (band.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    time, step = np.zeros(len(which)), 0
    while len(seed):
        step += 1
        with np.errstate(over="ignore"):
            a = mix(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            b = mix(a ^ np.uint64(0x5851F42D4C957F2D))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / width
        level = low + width * ((b >> np.uint64(32)).astype(float) / 2.0**32)
        place = (b & np.uint64(0xFFFFFFFF)) % np.uint64(places)
        counts = level < weight
        slot = d[counts] * places + place[counts].astype(np.int64)
        t, who = time[counts], a[counts]
        order = np.lexsort((t, slot))
        slot, t, who = slot[order], t[order], who[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, t, who = slot[first], t[first], who[first]
        earlier = t < best[slot]
        best[slot[earlier]], owner[slot[earlier]] = t[earlier], who[earlier]
        left = time < best.reshape(n_docs, places).max(axis=1)[d]
        d, seed, time, width, low, weight = d[left], seed[left], time[left], width[left], low[left], weight[left]
    return owner.reshape(n_docs, places)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), signature.shape[1] // rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = shingles.mix(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows] + np.arange(out.shape[1], dtype=np.uint64))
    return out.view(np.int64)


def _runs(texts: list[bytes]):
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= RUN_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _banded(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n, bands, mark, text`` from ``doc_id, text`` (binary); ``mark`` has a byte of each place of the signature, n counts the shingles."""
    import hashlib

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(1).to_pylist()):
                doc, key, times = shingles.shingle_counts(texts)
                places = signatures(doc, key, times, len(texts))
                has = np.bincount(doc, minlength=len(texts)) > 0
                bands = band_keys(places)[has].reshape(-1)
                edges = np.concatenate([[0], np.cumsum(np.where(has, PLACES // ROWS, 0))]).astype(np.int32)
                ids, whole = (batch.column(k).slice(at, len(texts)) for k in (0, 1))
                sizes = np.bincount(doc, weights=times, minlength=len(texts)).astype(np.int64)
                columns = [ids, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges), pa.array(bands)), pa.array([m.tobytes() for m in places.astype(np.uint8)], pa.binary()), whole]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "bands", "mark", "text"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, n long, bands array<long>, mark binary, text binary")


def _multisets(texts: DataFrame) -> DataFrame:
    """``rid, n, mark, elements`` from ``rid, n, mark, text``: the hashes of the shingle multiset in order."""

    def run(batches):
        for batch in batches:
            at = 0
            for run_ in _runs(batch.column(3).to_pylist()):
                owner, element = shingles.elements(*shingles.shingle_counts(run_))
                order = np.lexsort((element, owner))
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(run_)))]).astype(np.int32)
                known = [batch.column(k).slice(at, len(run_)) for k in range(3)]
                at += len(run_)
                yield pa.RecordBatch.from_arrays([*known, pa.ListArray.from_arrays(pa.array(edges), pa.array(element[order].view(np.int64)))], ["rid", "n", "mark", "elements"])

    return texts.mapInArrow(run, "rid long, n long, mark binary, elements array<long>")


def sketches(doc: np.ndarray, element: np.ndarray, n_docs: int) -> np.ndarray:
    """A byte (1 to 255) of the least hash of each bin of each text, 0 for empty bins."""
    hashed = shingles.mix(element ^ np.uint64(0x9FB21C651E98DF25))
    slot = doc * BINS + (hashed % np.uint64(BINS)).astype(np.int64)
    least = np.full(n_docs * BINS, MOST, np.uint64)
    np.minimum.at(least, slot, hashed >> np.uint64(10))
    byte = (shingles.mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return np.where(least == MOST, 0, byte).astype(np.uint8).reshape(n_docs, BINS)


class Held:
    """Texts that a task holds: rows sorted by task, with class, side, signature bytes and elements."""

    def __init__(self, task, side, c, n, mark, elements, offsets, similarity: float):
        self.side, self.c, self.n, self.mark, self.elements, self.offsets, self.similarity = side, c, n, mark, elements, offsets, similarity
        new = np.ones(len(task), bool)
        new[1:] = task[1:] != task[:-1]
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], len(task))
        _, self.node = np.unique(np.stack([self.group, np.unique(c, return_inverse=True)[1]]), axis=1, return_inverse=True)
        self.node = self.node.reshape(-1)

    def allowed(self, i, j, equal) -> np.ndarray:
        """Pairs that the rules of the task and the signatures leave."""
        least = self.similarity - SURE * (self.similarity * (1 - self.similarity) / self.mark.shape[1]) ** 0.5
        ok = (self.node[i] != self.node[j]) & ((self.side[i] != self.side[j]) | (self.side[i] == 0)) & (equal >= least * self.mark.shape[1])
        return ok & (np.minimum(self.n[i], self.n[j]) >= (self.similarity - 1e-9) * np.maximum(self.n[i], self.n[j]))

    def pairs(self):
        """(i, j) of all pairs that may be links by their signatures."""
        found = []
        size = self.end - self.first
        few = (size <= 64)[self.group]
        rest = np.where(few, self.end[self.group] - np.arange(len(self.group)) - 1, 0)
        for a in range(0, len(rest), 4096):  # small tasks together
            count = rest[a : a + 4096]
            i = np.repeat(np.arange(a, a + len(count)), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            ok = self.node[i] != self.node[j]
            i, j = i[ok], j[ok]
            ok = self.allowed(i, j, np.count_nonzero(self.mark[i] == self.mark[j], axis=1))
            found.append((i[ok], j[ok]))
        for g in np.flatnonzero(size > 64):
            lo, hi = int(self.first[g]), int(self.end[g])
            for a in range(lo, hi, 64):
                rows = np.arange(a, min(a + 64, hi))
                right = self.mark[a:hi]
                equal = np.count_nonzero(self.mark[rows][:, None] == right[None], axis=2)
                i, j = np.nonzero(equal > 0.5 * self.mark.shape[1])
                i, j, equal = i + a, j + a, equal[i, j]
                ok = (i < j) & self.allowed(i, j, equal)
                found.append((i[ok], j[ok]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def sketched(self, i, j):
        """Pairs that the sketches leave, and their estimates; bins are drawn without replacement, so small unions are nearly exact."""
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        marks = np.empty((len(used), BINS), np.uint8)
        for a in range(0, len(used), 512):
            rows = used[a : a + 512]
            parts = [self.elements[self.offsets[r] : self.offsets[r + 1]] for r in rows.tolist()]
            marks[a : a + 512] = sketches(np.repeat(np.arange(len(rows)), [len(p) for p in parts]), np.concatenate(parts), len(rows))
        x, y, s = place[: len(i)], place[len(i) :], self.similarity
        estimate, keep = np.empty(len(i)), np.empty(len(i), bool)
        for a in range(0, len(i), 20_000):
            u, v = marks[x[a : a + 20_000]], marks[y[a : a + 20_000]]
            empty = np.count_nonzero((u | v) == 0, axis=1)
            filled = np.maximum(1, BINS - empty)
            union = (self.n[i[a : a + 20_000]] + self.n[j[a : a + 20_000]]) / (1 + s)  # if the pair has just that similarity
            spread = np.sqrt(s * (1 - s) / filled * np.clip(1 - filled / union, 0, 1))
            share = (np.count_nonzero(u == v, axis=1) - empty) / filled
            estimate[a : a + 20_000], keep[a : a + 20_000] = share, share >= s - 0.01 - SURE * spread
        return i[keep], j[keep], estimate[keep]

    def linked(self, i: int, j: int) -> bool:
        """Whether two texts are near by exact multiset overlap."""
        x, y = self.elements[self.offsets[i] : self.offsets[i + 1]], self.elements[self.offsets[j] : self.offsets[j + 1]]
        at = np.minimum(y.searchsorted(x), len(y) - 1)
        shared = int(np.count_nonzero(y[at] == x))
        return 1 - shared / (len(x) + len(y) - shared) <= 1 - self.similarity + 1e-9

    def links(self) -> list[tuple[int, int]]:
        """Links that join all classes of a task which any link of the task joins."""
        i, j = self.pairs()
        if not len(i):
            return []
        i, j, estimate = self.sketched(i, j)
        order = np.argsort(-estimate, kind="stable")
        i, j = i[order], j[order]
        root = np.arange(int(self.node.max()) + 1)
        out, tries = [], 1
        while len(i):
            a, b = root[self.node[i]], root[self.node[j]]
            left = a != b
            i, j, a, b = i[left], j[left], a[left], b[left]
            if not len(i):
                break
            key = np.minimum(a, b) * len(root) + np.maximum(a, b)
            by = np.argsort(key, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = key[by][1:] != key[by][:-1]
            rank = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            test = np.zeros(len(i), bool)
            test[by[rank < tries]] = True  # the likeliest of each two classes
            parent = root.tolist()

            def find(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for p, q, x, y in zip(i[test].tolist(), j[test].tolist(), a[test].tolist(), b[test].tolist()):
                x, y = find(x), find(y)
                if x != y and self.linked(p, q):
                    parent[max(x, y)] = min(x, y)
                    out.append((p, q))
            root = np.array([find(k) for k in range(len(parent))])
            i, j, tries = i[~test], j[~test], tries * 2
        return out


def _links(dealt: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: joined classes, from ``task, side, c, n, mark, elements``."""

    def held(t: pa.Table):
        column = lambda name: t.column(name).to_numpy()
        elements = t.column("elements").combine_chunks()
        offsets = elements.offsets.to_numpy().astype(np.int64)
        mark = np.frombuffer(b"".join(t.column("mark").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return Held(column("task"), column("side"), column("c"), column("n"), mark, elements.values.to_numpy().view(np.uint64), offsets, similarity)

    def over(t: pa.Table):
        rows = held(t)
        found = rows.links()
        if found:
            i, j = (np.array(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(rows.c[i]), pa.array(rows.c[j])], ["a", "b"])

    def run(batches):
        carry = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            new = new if carry is None else pa.concat_tables([carry, new])
            task = new.column("task").to_numpy()
            edges = np.flatnonzero(task[1:] != task[:-1]) + 1
            last = int(edges[-1]) if len(edges) else 0
            if last:
                yield from over(new.slice(0, last).combine_chunks())
            carry = new.slice(last)
        if carry is not None and carry.num_rows:
            yield from over(carry.combine_chunks())

    ordered = dealt.select("task", "side", "c", "n", "mark", "elements").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "a long, b long")


def _contracted(links: DataFrame, parts: int) -> DataFrame:
    """The same classes by fewer and shorter links: each partition joins its own."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(k):
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        ends = [(k, find(k)) for k in list(parent)]
        ends = [(k, r) for k, r in ends if k != r]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], ["a", "b"])

    return links.select("a", "b").repartition(parts, "a").mapInArrow(run, "a long, b long")


def components(links: DataFrame, *, each: int = 50_000) -> DataFrame:
    """``id, class_id`` of all ends of ``links`` (a, b): the least id reachable over them.

    Partitions join their own links first; then each round takes the least class around and the class's own class, so long chains halve.
    """
    parts = parts_for(links.count(), each)
    short = stored(_contracted(links, parts), "links")
    deal = lambda df, *by: df.repartition(parts, *by)
    both = stored(deal(short.select("a", "b").union(short.select(F.col("b").alias("a"), F.col("a").alias("b"))), "b").dropDuplicates(["b", "a"]), "links")
    label = stored(deal(both, "a").groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("class_id")), "labels")
    dropped(short)
    while True:
        near = deal(deal(both, "b").join(deal(label, "id").withColumnRenamed("id", "b"), "b"), "a").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        lower = stored(deal(label, "id").join(near, "id").select("id", F.least("class_id", "near").alias("new"), F.col("class_id").alias("old")), "lower")
        dropped(label)
        if lower.where("new <> old").isEmpty():
            dropped(both)
            return lower.select("id", F.col("new").alias("class_id"))
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("above"))
        label = stored(deal(lower, "new").join(deal(jump, "new"), "new").select("id", F.least("new", "above").alias("class_id")), "labels")
        dropped(lower)


def _parts(count: str, elements: str):
    """Blocks that so many texts with so many elements need."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(elements) / BLOCK_ELEMENTS), F.lit(1)).cast("long")


def _same(column: str) -> list:
    """Aggregates that are equal for groups with the same members."""
    return [F.count("*").alias("k"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64(column)).alias("h1"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("h2")]


def _meetings(members: DataFrame) -> DataFrame:
    """``task, side, rid, c``: bucket members (b, rid, c, n) dealt to tasks in which all pairs of different classes meet.

    Rows of side 0 meet all others of their task, those of side 1 only those of side 2.
    """
    mixed = members.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("b")
    sizes = members.select("rid", "c").distinct().groupBy("c").agg(F.count("*").alias("texts")).where(F.col("texts") > BLOCK).select("c", F.lit(True).alias("large"))
    here = stored(members.join(mixed, "b").join(sizes, "c", "left").withColumn("large", F.coalesce("large", F.lit(False))), "mixed")
    # classes of usual size: bucket by bucket
    small = here.where("not large")
    kept = small.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *_same("rid")).where("lo <> hi")
    kept = kept.groupBy("k", "size", "h1", "h2").agg(F.min("b").alias("b")).select("b", _parts("k", "size").alias("parts"))
    block, other = F.pmod(F.xxhash64("rid"), F.col("parts")), F.col("other")
    spread = small.join(kept, "b").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("block") == other, 0).when(F.col("block") < other, 1).otherwise(2)
    usual = spread.select(F.xxhash64("b", F.least("block", "other"), F.greatest("block", "other")).alias("task"), side.alias("side"), "rid", "c")
    # large classes: each meets its neighbours once
    near = here.where("large").select("b", F.col("c").alias("own")).distinct()
    around = here.join(near, "b").where("c <> own and (not large or c > own)").select("own", "rid", "c", "n").distinct()
    inside = here.where("large").select(F.col("c").alias("own"), "rid", "c", "n").distinct()
    count = lambda df, x: df.groupBy("own").agg(F.count("*").alias("k"), F.sum("n").alias("size")).select("own", _parts("k", "size").alias(x))
    both = count(inside, "mine").join(count(around, "theirs"), "own")
    meet = lambda df, own, far, s: (
        df.join(both, "own").withColumn("i", F.pmod(F.xxhash64("rid"), F.col(own))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(far) - 1)))
        .select(F.xxhash64("own", F.lit("large"), *(("i", "j") if s == 1 else ("j", "i"))).alias("task"), F.lit(s).alias("side"), "rid", "c")
    )
    return usual.unionByName(meet(inside, "mine", "theirs", 1)).unionByName(meet(around, "theirs", "mine", 2))


def near_duplicate_classes(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, text_id, digest, class`` of every row: the least doc_id of the class, the least one with the same text, the text's SHA-256, and a number of the class that is its own."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    banded = stored(_banded(docs).withColumn("rid", F.monotonically_increasing_id()), "bands")
    # equal texts are one; the row with the least number stands for them
    texts = stored(banded.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("text_id")), "texts")
    single = stored(banded.join(texts.select("rid"), "rid", "left_semi").select("rid", "n", "bands"), "single")
    buckets = single.select("rid", "n", F.posexplode("bands").alias("band", "b"))
    shared = buckets.groupBy("b").agg(F.min("band").alias("band"), *_same("rid")).where("k > 1")
    # buckets with the same members are one
    shared = stored(shared.groupBy("k", "size", "h1", "h2").agg(F.min("b").alias("b"), F.min("band").alias("band")).select("b", "band", _parts("k", "size").alias("parts")), "shared")
    members = stored(buckets.select("b", "rid", "n").join(shared, "b"), "members")
    dropped(single, shared)
    # no side of this join is broadcast: both grow with the corpus
    sets = stored(_multisets(banded.select("rid", "n", "mark", "text").join(members.select("rid").distinct().hint("merge"), "rid", "left_semi")), "multisets")

    def met(dealt: DataFrame) -> DataFrame:
        """Links of the dealt texts; what a text meets travels with it."""
        wanted = dealt.groupBy("rid", "c").agg(F.collect_list(F.struct("task", "side")).alias("to"))
        rows = wanted.hint("merge").join(sets, "rid")
        return _links(rows.select(F.explode("to").alias("to"), "c", "n", "mark", "elements").select("to.task", "to.side", "c", "n", "mark", "elements"), similarity)

    first = members.where(F.col("band") < FIRST_BANDS)
    task = F.xxhash64("b", F.pmod(F.xxhash64("rid", "b"), F.col("parts")))
    links = stored(met(first.select(task.alias("task"), F.lit(0).alias("side"), "rid", F.col("rid").alias("c"))), "first-links")
    classes = components(links)
    of = stored(members.select("b", "rid", "n").join(classes.withColumnRenamed("id", "rid"), "rid", "left").select("b", "rid", "n", F.coalesce("class_id", "rid").alias("c")), "classed")
    more = stored(met(_meetings(of)), "second-links")
    above = components(more)
    joined = classes.join(above.select(F.col("id").alias("class_id"), F.col("class_id").alias("top")), "class_id", "left").select("id", F.coalesce("top", "class_id").alias("class"))
    joined = joined.unionByName(above.join(classes, "id", "left_anti").select("id", F.col("class_id").alias("class")))
    named = texts.join(joined.withColumnRenamed("id", "rid"), "rid", "left").select("digest", "text_id", F.coalesce("class", "rid").alias("class"))
    named = stored(named, "named")
    least = named.groupBy("class").agg(F.min("text_id").alias("class_id"))
    out = stored(banded.select("doc_id", "digest").join(named.join(least, "class").select("digest", "class_id", "text_id", "class"), "digest").select("doc_id", "class_id", "text_id", "digest", "class"), "near-duplicates")
    dropped(banded, texts, members, sets, links, classes, of, more, above, named)
    return out


def first_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` that stay: one of each class, with the least doc_id (null last); rows equal in id and text are one."""
    classes = near_duplicate_classes(documents, doc_id=doc_id, text=text, similarity=similarity)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    kept = classes.groupBy("class").agg(least).select(F.col("least.doc_id").alias("_kept_id"), F.col("least.digest").alias("_kept_digest"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256))
    rows = documents.withColumn("_digest", digest)
    same = (F.col("_digest") == F.col("_kept_digest")) & F.col(doc_id).eqNullSafe(F.col("_kept_id"))
    return rows.join(kept, same, "left_semi").dropDuplicates([doc_id, "_digest"]).drop("_digest")


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id")


QUERIES = {"op6_bagminhash": op6_bagminhash}
ORACLE_SQL: dict[str, str] = {}
