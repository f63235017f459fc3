"""Word shingles and exact groups, shared by near-duplicate steps.

Words are runs without ASCII white space, A-Z lower-cased; shingles are five consecutive
words (a shorter text is one shingle, a text without words has none).  A shingle that
occurs k times is the k elements (shingle, 1) .. (shingle, k) of a set, so the multiset overlap of
two texts is the plain overlap of their element sets.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts one after another, and the number of words of each text."""
    import itertools
    from collections import defaultdict

    import xxhash

    number = defaultdict(itertools.count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t.translate(_LOWER).split()), np.int64) for t in texts]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    sizes = np.array([len(x) for x in ids], np.int64)
    return (hashed[np.concatenate(ids)] if len(number) else np.zeros(0, np.uint64)), sizes


def shingle_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash, times), ordered by text and hash."""
    words, sizes = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        key = np.zeros(n, np.uint64)
        for j in range(WORDS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
        whole = doc[:n] == doc[WORDS - 1 : WORDS - 1 + n] if n else np.zeros(0, bool)
        keys, docs = [key[whole]], [doc[:n][whole]]
        for d in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
            k = np.zeros(1, np.uint64)
            for w in words[first[d] : first[d] + sizes[d]]:
                k = mix(k * np.uint64(0x9E3779B97F4A7C15) + w)
            keys.append(mix(k + np.uint64(sizes[d])))
            docs.append(np.array([d]))
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def elements(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, element hash) for each copy of each shingle."""
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        out = mix(np.repeat(key, times) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.repeat(doc, times), out
