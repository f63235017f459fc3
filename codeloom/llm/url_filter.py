"""Operator 10: exact URL filtering by a cascade of Bloom filters.

The corpus's complete key universe (every host suffix and path start a rule could
name, and every host) is known, so a filter over the listed keys can be made exact:
level 0 encodes the listed keys, level 1 the universe's other keys that pass level 0,
level 2 the listed keys that pass level 1, and so on until no key is wrong.
Lookup walks the levels; no list is joined to the pages.  Keys are dealt to shards by
hash, so each cascade is built by one task from a bounded number of keys.

Edge cases: a null url or one without ``://`` has an empty host and path, which no rule fits and no
list names (allow); repeated pages are judged alike; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SHARD_KEYS = 200_000
WAVE_BYTES = 64_000_000  # cascades sent to the workers at once
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


# --- one cascade: numpy over two 64-bit hashes of each key -------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (h2 + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        b ^= (b >> np.uint64(29)) << np.uint64(1)
        return (a[None, :] + np.arange(hashes, dtype=np.uint64)[:, None] * b[None, :]) % np.uint64(bits)


def _passes(level: int, bits: int, hashes: int, filled: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _places(h1, h2, level, bits, hashes)
    return ((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """Levels as (bits, hashes, bytes) one after another; empty if nothing is listed."""
    out, level = b"", 0
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        # the first level is sized for about as many false positives as listed keys, later ones for half
        ratio = max(2.0, len(outside) / len(inside)) if level == 0 else 2.0
        hashes = max(1, round(np.log2(ratio)))
        bits = max(64, int(np.ceil(len(inside) * hashes / np.log(2))))
        filled = np.zeros(bits // 8 + 1, np.uint8)
        at = _places(h1[inside], h2[inside], level, bits, hashes).ravel()
        np.bitwise_or.at(filled, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        out += struct.pack("<II", bits, hashes) + filled.tobytes()
        wrong = outside[_passes(level, bits, hashes, filled, h1[outside], h2[outside])] if len(outside) else outside
        inside, outside, level = wrong, inside, level + 1
    return out


def in_cascade(cascade: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed; exact for keys of the universe the cascade was built over."""
    answer, left, level, at = np.zeros(len(h1), bool), np.arange(len(h1)), 0, 0
    while at < len(cascade) and len(left):
        bits, hashes = struct.unpack_from("<II", cascade, at)
        filled = np.frombuffer(cascade, np.uint8, bits // 8 + 1, at + 8)
        left = left[_passes(level, bits, hashes, filled, h1[left], h2[left])]
        answer[left] = level % 2 == 0
        at, level = at + 8 + len(filled), level + 1
    return answer


# --- in Spark -----------------------------------------------------------------------------------


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def cascades(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """From ``key, listed`` (one row a key) the stored table ``shard, cascade``, and the number of shards."""
    shards = max(1, -(-universe.count() // shard_keys))
    keyed = universe.select(*_hashes(F.col("key")), "listed").withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [key[0]], "cascade": [build_cascade(a, b, frame["listed"].to_numpy(bool))]})

    return stored(keyed.groupBy("shard").applyInPandas(build, "shard int, cascade binary"), "cascades"), shards


def listed_keys(rows: DataFrame, keys: str, built: tuple[DataFrame, int], out: str) -> DataFrame:
    """``rows`` with ``out``: those of the array column ``keys`` that the cascade holds, in order.

    Cascades go to the workers in waves of bounded size; with one wave, nothing moves.
    """
    filters, shards = built
    sizes = [(r[0], r[1]) for r in filters.select("shard", F.length("cascade")).collect()]  # two numbers for SHARD_KEYS keys
    waves, size = [[]], 0
    for shard, n in sorted(sizes):
        if size + n > WAVE_BYTES and waves[-1]:
            waves.append([])
            size = 0
        waves[-1].append(shard)
        size += n
    pairs = F.transform(keys, lambda k: F.struct(*_hashes(k), F.pmod(F.xxhash64(k), F.lit(shards)).cast("int").alias("shard")))
    found = rows.withColumn(out, F.array().cast("array<string>"))
    for wave in waves:
        blobs = {r[0]: bytes(r[1]) for r in filters.where(F.col("shard").isin(wave)).collect()}
        schema = found.schema
        place = found.columns.index(keys), found.columns.index(out)

        def look_up(batches, blobs=blobs, place=place, names=tuple(found.columns)):
            for batch in batches:
                probes = batch.column(len(names))
                flat = probes.flatten()
                h1, h2, shard = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                hit = np.zeros(len(flat), bool)
                for s in np.unique(shard):
                    if s in blobs:
                        at = np.flatnonzero(shard == s)
                        hit[at] = in_cascade(blobs[s], h1[at].view(np.uint64), h2[at].view(np.uint64))
                ends = np.cumsum(probes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                rows, key_lists, had = [], batch.column(place[0]).to_pylist(), batch.column(place[1]).to_pylist()
                for row, (keys_, before) in enumerate(zip(key_lists, had)):
                    end = int(ends[row])
                    start = end - len(keys_ or ())
                    rows.append(before + [k for k, yes in zip(keys_ or (), hit[start:end]) if yes])
                columns = [batch.column(j) for j in range(len(names))]
                columns[place[1]] = pa.array(rows, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, list(names))

        found = found.withColumn("_probes", pairs).mapInArrow(look_up, schema)
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every start of the path that is as long as some rule's."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))
    starts = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict``.

    A page that no rule fits is blocked when its host is listed: at least half of the host's
    pages are blocked by rules (a list that comes from the corpus and grows with it).
    """
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r, _ in rules})
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", F.array_distinct(rule_keys(F.col("host"), F.col("path"), lengths)))

    universe = stored(rows.select(F.explode("keys").alias("key")).distinct(), "keys")
    found = rows
    for verdict in ("allow", "block"):
        names = [r for r, v in rules if v == verdict]
        built = cascades(universe.withColumn("listed", F.col("key").isin(names)))
        found = listed_keys(found, "keys", built, verdict)
    longest = lambda c: F.coalesce(F.try_element_at(F.array_sort(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), F.lit(-1))["n"], F.lit(0))
    pick = lambda c: F.try_element_at(F.array_sort(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))), F.lit(-1))["k"]
    spark_safe = found.withColumn("_a", longest(F.col("allow"))).withColumn("_b", longest(F.col("block")))
    ruled = spark_safe.select(
        "page_id", "host", "path",
        F.when(F.col("_a") + F.col("_b") == 0, F.lit(None)).when(F.col("_a") >= F.col("_b"), pick(F.col("allow"))).otherwise(pick(F.col("block"))).alias("rule"),
        F.when(F.col("_a") + F.col("_b") == 0, F.lit(None)).when(F.col("_a") >= F.col("_b"), "allow").otherwise("block").alias("ruling"),
    )
    ruled = stored(ruled, "ruled")

    blocked = F.sum(F.when(F.col("ruling") == "block", 1).otherwise(0))
    hosts = stored(ruled.where("host != ''").groupBy(F.col("host").alias("key")).agg((2 * blocked >= F.count("*")).alias("listed")), "hosts")
    judged = listed_keys(ruled.withColumn("keys", F.when(F.col("host") != "", F.array("host")).otherwise(F.array().cast("array<string>"))), "keys", cascades(hosts), "named")
    verdict = F.coalesce(F.col("ruling"), F.when(F.size("named") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_HOST = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(
    f"WHEN ('.' || host) LIKE '%.{r[: r.index('/')]}' AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
)
_VERDICTS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
ORACLE_SQL = {
    "op10_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {_FITS} END AS rule FROM h),
v AS (SELECT *, CASE rule {_VERDICTS} END AS ruling FROM r),
l AS (SELECT host FROM v WHERE host <> '' GROUP BY host HAVING 2 * sum(CASE WHEN ruling = 'block' THEN 1 ELSE 0 END) >= count(*))
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM v"""
}
QUERIES = {"op10_url_filter": op10_url_filter}
