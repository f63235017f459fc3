"""Operator 1: exact substring removal with suffix arrays made by bucket-pointer refinement.

Bytes covered by a string of ``span`` bytes that also starts in a document with a smaller id go.
A suffix array of the whole corpus would sort every byte; here only places that can match are sorted:

1. Every window of ``span`` bytes has an anchor, the q-gram in it with the least hash.  Equal windows
   have equal anchors, so windows meet at the shard of their anchor's hash.  Neighbouring windows with one
   anchor form a stretch (about 1 for 14 bytes), which is sent as two hashes: of the anchor and of all its bytes.
2. A shard keeps the least document of every (anchor, stretch); the same stretch in other documents goes as a whole.
   Different stretches with one anchor may share some windows: these are undecided.
3. Undecided stretches send their bytes to the anchor's shard.  There the suffix array of these bytes is refined:
   buckets by the first q bytes, then sorting within buckets by the bucket numbers of later offsets, which the
   refinement itself keeps up to date, until suffixes are told apart by their first ``span`` bytes.
4. Each document's own partition merges what has to go and hashes what stays.

A run of documents resolves its own repeats before it sends anything, so a passage that a third of all
documents share reaches a shard once for each run.  Texts travel once, compressed.

Edge cases: null and empty texts have nothing to remove; equal texts lose all bytes from the second id on if
they have ``span`` bytes; ids are whole numbers, a null id is smaller than
all others; rows that share a doc_id are judged each on its own against smaller ids; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import shards_for, table
from .shingles import mix

SPAN, Q = 50, 24
RUN_BYTES = 3_000_000
SHARD_BYTES = 16_000_000  # text that a shard keeps
PART_BYTES = 1_000_000  # undecided bytes whose suffixes are sorted together, but for one anchor with more
NO_ID = -(2**63)  # stands for a null id
SEGMENT = 250_000  # windows hashed at once


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from every place (doubling: 1, 2, 4 .. bytes)."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        powers, part, size = base, data.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        while True:
            if q & size:
                if out is None:
                    out, done, out_power = part, size, powers
                else:
                    n = min(len(out), len(part) - done)
                    out = out[:n] * powers + part[done : done + n]
                    done += size
            if size * 2 > q:
                return mix(out)
            part = part[: len(part) - size] * powers + part[size:]
            powers, size = powers * powers, size * 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, part = 1, x
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    rest = w - size
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


def stretches(texts: list[bytes], span: int = SPAN, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, stretch hash, first window, windows) of each run of a text's windows with one anchor."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    parts = []
    for a in range(0, max(0, len(whole) - span + 1), SEGMENT):
        data = whole[a : a + SEGMENT + span - 1]
        h = gram_hashes(data, q)
        place = np.arange(len(h), dtype=np.uint64) & np.uint64(63)
        least = sliding_min((h & ~np.uint64(63)) | place, span - q + 1)
        n = len(least)
        s = np.flatnonzero(owner[a : a + n] == owner[a + span - 1 : a + span - 1 + n])  # windows that stay in their text
        if not len(s):
            continue
        anchor, text = s + (((least[s] & np.uint64(63)).astype(np.int64) - s) & 63), owner[a + s]
        new = np.ones(len(s), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        first, count = s[at], np.diff(np.append(at, len(s)))
        end = first + count - 1 + span  # one behind the stretch's last byte
        with np.errstate(over="ignore"):
            g = (end - first).astype(np.uint64)
            for k in range(0, 2 * span, q):  # q-grams that cover it, the last one at its end
                g = mix(g * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(first + k, end - q)])
        # 96 bits tell stretches apart
        parts.append((text[at], mix(h[anchor[at]]) >> np.uint64(16), g >> np.uint64(16), first + a - begin[text[at]], count))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _by_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by h, and in it the places of values that occur more than once."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    return order, np.flatnonzero(same[1:] | same[:-1])


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in sorted order (equal keys: the first one's), and how many share it."""
    order = np.argsort(key)
    edges = blobs.groups(key[order])
    size = np.diff(edges)
    number, members = np.empty(len(key), np.uint64), np.empty(len(key), np.int64)
    number[order], members[order] = np.repeat(edges[:-1], size), np.repeat(size, size)
    return number, members


def refined_classes(data: np.ndarray, starts: np.ndarray, span: int, q: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``starts``, class): those whose ``span`` bytes occur at another start too; equal bytes, equal class.

    Bucket-pointer refinement: buckets begin as the ranks of q-grams.  A pass sorts by (own bucket, bucket of the place as
    many bytes on as are sorted already), which doubles the sorted length, and the new numbers serve the next pass.
    Suffixes are told apart by ``span`` bytes only; a start alone in its bucket is finished, and a pass renumbers just the
    places that later passes look up for the starts that are left.
    """
    gram = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(q, np.uint64)])
    for k in range(q):
        gram = (gram << np.uint64(8)) | padded[k : k + len(data)]
    bucket, done, steps = _numbered(gram)[0], q, []
    while done < span:
        steps.append(min(done, span - done))
        done += steps[-1]
    wanted = [np.zeros(1, np.int64)]  # offsets from a start at which each pass gives numbers, last pass first
    for step in steps[:0:-1]:
        wanted.append(np.unique(np.concatenate([wanted[-1], wanted[-1] + step])))
    left = np.arange(len(starts))
    for step, offsets in zip(steps, wanted[::-1]):
        left = left[_numbered(bucket[starts[left]])[1] > 1]
        if not len(left):
            break
        need = np.zeros(len(data), bool)
        for k in offsets.tolist():
            need[starts[left] + k] = True
        need = np.flatnonzero(need)
        new = np.zeros(len(data), np.uint64)
        new[need] = _numbered((bucket[need] << np.uint64(32)) | bucket[need + step])[0]
        bucket = new
    left = left[_numbered(bucket[starts[left]])[1] > 1]
    return left, bucket[starts[left]]


def _shared_windows(messages: list[bytes], span: int):
    """From undecided stretches (anchor, row, document, first, windows, bytes): windows that a smaller document has.

    Anchors are dealt to parts of about PART_BYTES, each sorted on its own, because equal windows have equal anchors.
    """
    parts = [blobs.unpack(m) for m in messages]
    sender = np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(parts)])
    anchor = np.concatenate([p[0] for p in parts])
    rows, docs, first, count = (np.concatenate([p[j].astype(np.int64) for p in parts]) for j in range(1, 5))
    data = np.concatenate([p[5] for p in parts])
    lengths = count + span - 1
    begin = np.cumsum(lengths) - lengths
    part = (mix(anchor) % np.uint64(-(-len(data) // PART_BYTES) or 1)).astype(np.int64)
    dealt = np.argsort(part, kind="stable")
    edges = blobs.groups(part[dealt])
    for a, b in zip(edges[:-1], edges[1:]):
        i = dealt[a:b]
        at = np.cumsum(lengths[i]) - lengths[i]
        own = data[np.repeat(begin[i] - at, lengths[i]) + np.arange(lengths[i].sum())]
        owner = np.repeat(np.arange(len(i)), count[i])
        offset = np.arange(count[i].sum()) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
        open_, number = refined_classes(own, at[owner] + offset, span)
        if not len(open_):
            continue
        who = docs[i][owner[open_]]
        order = np.lexsort((who, number))
        runs = blobs.groups(number[order])
        least = np.repeat(who[order][runs[:-1]], np.diff(runs))
        gone = open_[order[who[order] > least]]
        k = i[owner[gone]]
        yield sender[k], rows[k], first[k] + offset[gone]


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document (and ``kept``, its remaining bytes, if wanted)."""
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    shards = shards_for(rows, SHARD_BYTES)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    if rows.isEmpty():
        return spark.createDataFrame([], schema)

    # partitions 0 .. shards-1 receive anchors, shards .. 2*shards-1 receive documents
    def send(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts, at, size = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= RUN_BYTES or k == len(texts) - 1:
                    found = list(_run(ids[at : k + 1], texts[at : k + 1], f"{part} {turn}"))
                    turn += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["key", "blob"])
                    at, size = k + 1, 0

    def _run(ids, texts, which):
        home = (mix(ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        name = int.from_bytes(hashlib.sha256(which.encode() + ids.tobytes() + b"".join(texts)).digest()[:7], "little")  # a run's own number, the same if it is made again
        place = np.zeros(len(ids), np.int64)  # row within the message to the document's home
        for b in np.unique(home):
            at = np.flatnonzero(home == b)
            place[at] = np.arange(len(at))
        doc, h, g, first, count = stretches(texts, span)
        order, several = _by_hash(h)
        x = order[several]
        order[several] = x[np.lexsort((ids[doc[x]], g[x], h[x]))]
        h, g, first, count, doc = h[order], g[order], first[order], count[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        least = ids[doc][new][np.cumsum(new) - 1] if len(h) else ids[:0]
        local = ids[doc] > least  # a smaller document of this run has the stretch
        shard = (h % np.uint64(shards)).astype(np.int64)
        go = np.flatnonzero(new)
        go = go[np.argsort(shard[go], kind="stable")]
        edges = blobs.groups(shard[go])
        for a, b in zip(edges[:-1], edges[1:]):
            i = go[a:b]
            yield int(shard[i[0]]), blobs.pack(np.array([name]), np.diff(h[i], prepend=np.uint64(0)), g[i], ids, blobs.small(doc[i]), blobs.small(first[i]), blobs.small(count[i]))
        # stretches with equal hashes in one document and run follow the first of them
        told = np.flatnonzero(~new)
        lead_of = np.flatnonzero(new)[np.cumsum(new)[told] - 1]
        by = np.argsort(home[doc[told]], kind="stable")
        told, lead_of = told[by], lead_of[by]
        home_of = home[doc[told]]
        for b in np.unique(home):
            at = np.flatnonzero(home == b)
            i, j = np.searchsorted(home_of, [b, b + 1])
            mine, lead = told[i:j], lead_of[i:j]
            data = np.frombuffer(b"".join(texts[k] for k in at), np.uint8)  # the texts, most of what is sent
            yield shards + int(b), blobs.pack(
                np.array([name]), ids[at], np.array([len(texts[k]) for k in at]), data, blobs.small(place[doc[mine]]), blobs.small(first[mine]), blobs.small(count[mine]),
                local[mine].astype(np.uint8), blobs.small(at), blobs.small(first[lead]), blobs.small(place[doc[lead]]),
            )

    sent = blobs.sent(rows.mapInArrow(send, "key int, blob binary"), 2 * shards)

    def match(index, pairs):
        """Step 2, at the anchors' shards: replies to documents' homes, whole (1) or undecided (2)."""
        if index >= shards:
            return
        parts = [blobs.unpack(b) for _, b in pairs]
        if not parts:
            return
        run = np.concatenate([np.full(len(p[1]), k) for k, p in enumerate(parts)])
        h = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
        g = np.concatenate([p[2] for p in parts])
        row = np.concatenate([p[4].astype(np.int64) for p in parts])
        doc = np.concatenate([p[3][p[4]] for p in parts])
        first, count = (np.concatenate([p[j].astype(np.int64) for p in parts]) for j in (5, 6))
        order, several = _by_hash(h)
        order = order[several]  # an anchor that occurs once takes no part
        order = order[np.lexsort((doc[order], g[order], h[order]))]
        hs, gs = h[order], g[order]
        new_h = np.ones(len(hs), bool)
        new_h[1:] = hs[1:] != hs[:-1]
        new = new_h.copy()
        new[1:] |= gs[1:] != gs[:-1]
        if not len(order):
            return
        several = np.bincount(np.cumsum(new_h) - 1, weights=new)[np.cumsum(new_h) - 1] > 1
        least = doc[order][new][np.cumsum(new) - 1]
        whole = doc[order] > least
        # equal ids in different runs (repeated ids) stay undecided together
        state = np.where(whole, 1, np.where(several, 2, 0))
        at = np.flatnonzero(state)
        i, state = order[at], state[at]
        home = (mix(doc[i].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        by = np.lexsort((run[i], home))
        i, state, home = i[by], state[by], home[by]
        names = np.array([int(p[0][0]) for p in parts])
        edges = blobs.groups(home)
        for a, b in zip(edges[:-1], edges[1:]):
            k = i[a:b]
            yield shards + int(home[a]), blobs.pack(np.array([index, 1]), blobs.small(run[k]), blobs.small(row[k]), doc[k], blobs.small(first[k]), blobs.small(count[k]), state[a:b].astype(np.uint8), h[k], names)

    replied = blobs.resent(sent.mapPartitionsWithIndex(match), 2 * shards)

    class Home:
        """Documents of one partition, in the order of their runs' names, and what was replied about them."""

        def __init__(self, pairs):
            found = [blobs.unpack(blob) for _, blob in pairs]
            self.replies = [p for p in found if len(p[0]) == 2]
            self.docs = sorted((p for p in found if len(p[0]) == 1), key=lambda p: int(p[0][0]))
            self.runs = {int(p[0][0]): k for k, p in enumerate(self.docs)}
            none = [np.zeros(0, np.int64)]
            self.ids, self.sizes = (np.concatenate(none + [p[j] for p in self.docs]).astype(np.int64) for j in (1, 2))
            self.data = np.concatenate([np.zeros(0, np.uint8)] + [p[3] for p in self.docs])
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.base = np.cumsum([0] + [len(p[1]) for p in self.docs])
            self.places = np.concatenate(none + [(k << 32) | p[8].astype(np.int64) for k, p in enumerate(self.docs)])

        def rows(self, p, at):
            """Rows of the documents that places ``at`` of a reply are about: by the run's name and the row in that run."""
            run = np.array([self.runs.get(x, -1) for x in p[8].tolist()], np.int64)
            return np.searchsorted(self.places, (run[p[1][at]] << 32) | p[2][at].astype(np.int64))

        def mark(self, gone, start, windows):
            np.add.at(gone, start, 1)
            np.add.at(gone, start + windows, -1)

    def undecided(index, pairs):
        """Step 3: undecided stretches with their bytes, to the anchors' shards."""
        if index < shards:
            return
        home = Home(pairs)
        for p in home.replies:
            at = np.flatnonzero(p[6] == 2)
            if not len(at):
                continue
            where, first, count = home.rows(p, at), p[4][at].astype(np.int64), p[5][at].astype(np.int64)
            start, length = home.begin[where] + first, count + span - 1
            take = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
            yield int(p[0][0]), blobs.pack(p[7][at], blobs.small(where), p[3][at], blobs.small(first), blobs.small(count), home.data[take], np.array([index]))

    asked = blobs.resent(blobs.together(replied, sent).mapPartitionsWithIndex(undecided), 2 * shards)

    def refine(pairs):
        messages = [b for _, b in pairs]
        if not messages:
            return
        heads = [int(blobs.unpack(m)[6][0]) for m in messages]
        found = list(_shared_windows(messages, span))
        if not found:
            return
        of, row, window = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((window, row, of))
        of, row, window = of[order], row[order], window[order]
        edges = blobs.groups(of)
        for a, b in zip(edges[:-1], edges[1:]):
            yield heads[of[a]], blobs.pack(np.array([0, 2]), blobs.small(row[a:b]), blobs.small(window[a:b]))

    refined = blobs.resent(asked.mapPartitions(refine), 2 * shards)

    def finish(index, pairs):
        """Step 4."""
        if index < shards:
            return
        home = Home(pairs)
        gone = np.zeros(len(home.data) + 1, np.int32)  # runs of removed windows that begin less those that end, at each window's first byte
        for k, p in enumerate(home.docs):
            local = p[7] > 0
            home.mark(gone, home.begin[home.base[k] + p[4][local]] + p[5][local].astype(np.int64), p[6][local].astype(np.int64))
        for p in home.replies:
            if p[0][1] == 1:
                at = np.flatnonzero(p[6] == 1)
                home.mark(gone, home.begin[home.rows(p, at)] + p[4][at].astype(np.int64), p[5][at].astype(np.int64))
            else:
                home.mark(gone, home.begin[p[1]] + p[2].astype(np.int64), np.ones(len(p[1]), np.int64))
        # repeats within one document and run: the windows that went from the first went because a smaller document has them
        # (windows, not bytes: windows outside the stretch may cover bytes of the first that the others keep)
        went = np.cumsum(gone, dtype=np.int32) > 0
        for k, p in enumerate(home.docs):
            follow = np.flatnonzero(p[7] == 0)
            own, lead = home.begin[home.base[k] + p[4][follow]] + p[5][follow].astype(np.int64), home.begin[home.base[k] + p[10][follow]] + p[9][follow].astype(np.int64)
            for a, b, n in zip(own.tolist(), lead.tolist(), p[6][follow].tolist()):
                went[a : a + n] |= went[b : b + n]
        change = np.diff(went.view(np.int8), prepend=np.int8(0))
        begins, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
        gone[:] = 0
        gone[begins] += 1
        gone[ends + span - 1] -= 1
        covered = np.cumsum(gone, dtype=np.int32)[:-1] > 0
        for d, a, n in zip(home.ids.tolist(), home.begin.tolist(), home.sizes.tolist()):
            c = covered[a : a + n]
            kept = home.data[a : a + n][~c].tobytes()
            removed = n - len(kept)
            spans = int(np.count_nonzero(c[1:] & ~c[:-1]) + (n > 0 and bool(c[0]))) if removed else 0
            row = (None if d == NO_ID else d, n, removed, spans, hashlib.sha256(kept).hexdigest())
            yield (*row, kept) if with_text else row

    return spark.createDataFrame(blobs.together(replied, refined, sent).mapPartitionsWithIndex(finish), schema, verifySchema=False)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
