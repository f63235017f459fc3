"""Operator 2: best-fit packing with bounds that certify each partition's bin count.

Pieces are dealt to partitions of bounded size; each runs best-fit decreasing on
its own.  Dual feasible functions give a lower bound from the partition's length
histogram: a partition that meets it is finished.  The others exchange documents
(they are dealt anew, together) and run again, and what improves is kept.  At the end
the loosest bin of every partition, certified or not, goes into one more exchange, because rounding up loses
a part of a bin for each partition.

Edge cases: a null or empty text is a document of the end id alone; equal rows are packed
like any others; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import stored, table, text_or_empty

GROUP_PIECES = 20_000  # pieces a partition packs at once
ROUNDS = 2

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

PIECES = "piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids as little-endian 32-bit bytes.

    Where the vocabulary file's own rules allow it (``tokens.words_are_safe``), words are encoded one by one and
    remembered in lower case without the punctuation behind them; other files encode whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer, self.memo, self.by_word = tokens.load(path), tokens.Memo(b""), tokens.words_are_safe(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> None:
        for run in tokens.by_bytes(words, len):
            for word, e in zip(run, self.encode([w.decode() for w in run], add_special_tokens=False)):
                self.memo[word] = array("I", e.ids).tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Words of letters alone are one piece each: a call encodes many, and its ids are cut behind each piece."""
        for run in tokens.by_bytes(words, len):
            ids = np.asarray(self.encode([b" ".join(run).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(run) or cuts[-1] != len(ids):  # the library knows other letters than Python does
                self._each(run)
                continue
            body, at = ids.tobytes(), 0
            for word, cut in zip(run, (4 * cuts).tolist()):
                self.memo[word] = body[at:cut]
                at = cut

    def _fill(self) -> None:
        memo, parts = self.memo, {}
        letters, others = set(), set()

        def want(word: bytes) -> None:
            if word not in memo:
                (letters if word.decode().isalpha() else others).add(word)

        for word in set(memo.wanted):
            core = word.rstrip(_PUNCTUATION)
            if core and len(core) < len(word) and b"<|" not in word and core.decode()[-1].isalpha():
                parts[word] = core, word[len(core) :]
                want(core)
                want(word[len(core) :])
            else:
                want(word)
        memo.wanted.clear()
        self._letters(list(letters))
        self._each(list(others))
        for word, (core, rest) in parts.items():
            memo[word] = dict.__getitem__(memo, core) + dict.__getitem__(memo, rest)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [array("I", e.ids).tobytes() for run in tokens.by_bytes(texts, len) for e in self.encode(run, add_special_tokens=False)]
        memo = self.memo
        memo.trim()
        raw = [t.encode() for t in texts]
        # bytes.split: ASCII white space alone; "<|" may begin a special string, which is matched before lower-casing
        words = [(t if b"<|" in t else t.translate(_LOWER)).split() for t in raw]
        found = [b"".join(map(memo.__getitem__, x)) if not memo.wanted else None for x in words]
        if memo.wanted:
            for x, done in zip(words, found):
                if done is None:
                    deque(map(memo.__getitem__, x), 0)
            first = next((k for k, done in enumerate(found) if done is None), len(found))
            self._fill()
            found[max(0, first - 1) :] = [b"".join(map(memo.__getitem__, x)) for x in words[max(0, first - 1) :]]
        return found


_ENCODERS: dict[str, Encoder] = {}


def pieces_of(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents' ids and the end id, cut at ``capacity``."""
    path = vocabulary or tokens.public_path("word_bpe_49k.json")
    rows = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(df, text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at, rows = 0, ([], [], [], [], [])
            for run in tokens.by_bytes(texts, len, 4_000_000):
                for k, body in enumerate(encoder(run), at):
                    body += end
                    for p, i in enumerate(range(0, len(body), step)):
                        part = body[i : i + step]
                        for column, value in zip(rows, (k, p, i // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                at += len(run)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *(pa.array(x, t) for x, t in zip(rows[1:], kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Most that the dual feasible functions f_k prove: f_k(x) is capacity for x > capacity - k, 0 for x < k, else x.

    ``counts[x]`` is the number of pieces of length x.
    """
    sizes = np.arange(capacity + 1)
    number, amount = np.cumsum(counts), np.cumsum(counts * sizes)
    k = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    below = np.where(k > 0, amount[np.maximum(k - 1, 0)], 0)
    return int((-(-(large * capacity + amount[capacity - k] - below) // capacity)).max(initial=0))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins; each piece goes to the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, count = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = count, capacity
            count += 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, count


def _packed(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Deal the pieces to ``groups`` partitions and pack each: adds part, bin, offset, fill, bins and the certificate."""
    columns = [f"{x.name} {x.dataType.simpleString()}" for x in pieces.schema]
    names = pieces.columns

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        loosest = int(fill.argmin()) if count else -1
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return frame[names].assign(part=key[0], bin=bins, offset=offsets, bins=count, bound=bound, loosest=bins == loosest)

    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(groups)))
    return dealt.groupBy("_part").applyInPandas(pack, ", ".join([*columns, "part long, bin long, offset long, bins long, bound long, loosest boolean"]))


def best_fit_packing(pieces: DataFrame, *, capacity: int = 2048, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no two pieces overlap, no sequence is longer than ``capacity``."""
    names = pieces.columns
    done: list[DataFrame] = []
    aside: list[DataFrame] = []  # the loosest bin of each partition of several, for the last exchange

    def settle(df: DataFrame, turn: int) -> None:
        number = F.lit(turn << 58) + F.shiftleft(F.col("part"), 22) + F.col("bin")
        done.append(df.select(*names, number.alias("sequence_id"), "offset"))

    groups = max(1, -(-pieces.count() // group_pieces))
    several = groups > 1
    packed, turn = stored(_packed(pieces, groups, 0, capacity), "packed"), 0
    for turn in range(1, rounds + 1):
        gap = packed.where("bins > bound")
        n = gap.count()
        if groups == 1 or not n:
            break
        groups = max(1, -(-n // group_pieces))
        again = stored(_packed(gap.select(*names), groups, turn, capacity), "repacked")
        count = lambda df: df.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if count(again) >= count(gap):
            break
        settle(packed.where("bins <= bound and not loosest"), turn - 1)
        aside.append(packed.where("bins <= bound and loosest").select(*names))
        packed = again
    settle(packed.where("not loosest") if several else packed, turn)
    if several:
        loose = packed.where("loosest").select(*names)
        for more in aside:
            loose = loose.unionByName(more)
        loose = stored(loose, "loosest")
        again = _packed(loose, max(1, -(-loose.count() // group_pieces)), rounds + 1, capacity)
        settle(stored(again, "last"), rounds + 2)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def certificate(packed: DataFrame, *, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, sequences that any packing of these pieces needs), from the histogram of lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(pieces_of(table(spark, sf_dir, "documents")), "pieces")
    return best_fit_packing(pieces)


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
