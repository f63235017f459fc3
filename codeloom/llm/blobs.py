"""Compressed messages between tasks.

Operators that exchange something for every byte or word send packed arrays instead of
rows: one record for each sending run and receiving partition.  The messages travel as
(partition, bytes) pairs of an RDD, because its shuffle files can serve several jobs; a lost
executor's part is made again from its lineage.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame


def partition_of(key: int) -> int:
    """The one partitioner of all messages: keys are partition numbers."""
    return key


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; bytes of equal weight lie together, which compresses small numbers well."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
        head.append(struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(a)))
        body.append(planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, heads = 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, at)
        heads.append((np.dtype("<" + kind.decode().strip()), size))
        at += 12
    out = []
    for kind, size in heads:
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1) if size else np.zeros(0, kind))
        at += size * kind.itemsize
    return out


def sent(messages: DataFrame, partitions: int) -> RDD:
    """(key, blob) pairs of a DataFrame with those columns, at their partitions."""
    return messages.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(partitions, partition_of)


def resent(pairs: RDD, partitions: int) -> RDD:
    return pairs.partitionBy(partitions, partition_of)


def together(*rdds: RDD) -> RDD:
    """Messages of equally dealt RDDs, partition by partition, without moving them again."""
    out = rdds[0]
    for other in rdds[1:]:
        out = out.union(other)
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the narrowest type."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])
