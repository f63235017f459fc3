"""Operator 7 (native): benchmark decontamination with a distributed positional inverted index.

Every text is split once.  The index holds the postings (term, document, position) of all training tokens whose
term stands in some test window, stored as a table.  A window's search starts from its rarest terms by corpus
frequency: candidates come from the rarest term's postings, moved back by the term's offset in the window, and are
intersected with the moved postings of the next rarest one.  What is left is compared with the words themselves, so
phrase matches are exact.  ``proximity`` reads the same postings for items whose rarest terms stand near each other.

Only DataFrame functions run here.  The benchmark side (terms, windows) is broadcast
when its size, which is counted first, is under a bound; beyond it Spark joins by shuffle.

Edge cases: documents are told apart by a row number, so null and repeated ids are rows of their own; null and empty
texts have no words and hit nothing; items without words have no windows; equal items and equal rows each count;
empty tables give no hits; columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table

WINDOW_WORDS = 10
NEAR_TERMS, WITHIN = 3, 20  # proximity: a window's three rarest terms within twenty words
BROADCAST_WINDOWS = 200_000  # test windows up to which the benchmark side goes to every executor
BROADCAST_ROWS = 2_000_000  # row numbers (8 bytes each) up to which documents with candidates go to every executor
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: characters between words: all ASCII but digits and lower-case letters, after lower-casing
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; no words for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def windows_of(items: DataFrame, *, item_id: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, words``: the distinct runs of ``size`` consecutive words; a shorter item is one window."""
    rows = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words")).distinct()


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class Index:
    """Split texts (``rid, doc_id, n_words, words``) and the postings (``term, rid, pos``, positions from 0) of the terms of ``windows``."""

    def __init__(self, documents: DataFrame, windows: DataFrame, small: bool, *, doc_id: str = "doc_id", text: str = "text", digest: bool = False):
        rows = documents.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
        self.small = small
        if digest:
            rows = documents.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"), F.sha2(F.col(text), 256).alias("digest"))
        self.split = stored(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), *rows.columns[1:]), "split")
        self.terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "terms")
        each = self.split.select("rid", F.posexplode("words").alias("pos", "term"))
        self.postings = stored(each.join(_maybe_broadcast(self.terms, small), "term", "left_semi").select("term", "rid", "pos"), "postings")
        freq = self.postings.groupBy("term").count()
        self.frequencies = stored(self.terms.join(freq, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n")), "frequencies")

    def probes(self, windows: DataFrame, rarest: int) -> DataFrame:
        """``window_id, term, offset, place``: each window's rarest terms, rarest first (place 1)."""
        rows = windows.select("window_id", F.posexplode("words").alias("offset", "term")).join(_maybe_broadcast(self.frequencies, self.small), "term")
        first = rows.groupBy("window_id", "term", "n").agg(F.min("offset").alias("offset"))
        ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("window_id").orderBy("n", "term")))
        # a window with a term that no document has cannot occur
        lowest = ranked.withColumn("least", F.min("n").over(Window.partitionBy("window_id")))
        return stored(lowest.where((F.col("place") <= rarest) & (F.col("least") > 0)).select("window_id", "term", "offset", "place"), "probes")

    def drop(self) -> None:
        dropped(self.terms, self.postings, self.frequencies)


def _numbered(listed: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct windows with their ids, and whether they are few enough to broadcast."""
    windows = stored(listed.select("words").distinct().withColumn("window_id", F.xxhash64(F.concat_ws(" ", "words"))), "distinct-windows")
    return windows, windows.count() <= BROADCAST_WINDOWS


def occurrences(index: Index, listed: DataFrame, windows: DataFrame, *, rarest: int = 2) -> DataFrame:
    """``rid, start, length, item_id``: every place where a window of an item stands, word for word.

    A place where several items' windows stand has a row for each item.
    """
    small = index.small
    probes = index.probes(windows, rarest)
    moved = index.postings.join(_maybe_broadcast(probes, small), "term").select("rid", "window_id", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    # the lists meet: a start is left when each of the window's rarest terms stands at its offset
    needed = probes.groupBy("window_id").agg(F.max("place").alias("needed"))
    met = moved.groupBy("rid", "window_id", "start").agg(F.count("*").alias("lists"))
    candidates = stored(met.join(_maybe_broadcast(needed, small), "window_id").where("lists >= needed").select("rid", "window_id", "start"), "candidates")
    # the words themselves, of documents with a candidate; each document's tries are gathered as numbers only
    tries = candidates.groupBy("rid").agg(F.collect_list(F.struct("start", "window_id")).alias("tries"))
    there = F.explode(F.transform("tries", lambda t: F.struct(t["start"].alias("start"), t["window_id"].alias("window_id"), F.slice(F.col("words"), t["start"] + 1, WINDOW_WORDS).alias("found"))))
    rids = candidates.select("rid").distinct()
    texts = index.split.select("rid", "words")
    if rids.count() <= BROADCAST_ROWS:  # other texts need not move
        texts = texts.join(F.broadcast(rids), "rid", "left_semi")
    shown = texts.join(tries, "rid").select("rid", there.alias("t")).select("rid", "t.*")
    same = F.slice("found", 1, F.size("words")) == F.col("words")
    hits = shown.join(_maybe_broadcast(windows, small), "window_id").where(same).select("rid", "start", F.size("words").alias("length"), "window_id")
    named = listed.select("item_id", F.xxhash64(F.concat_ws(" ", "words")).alias("window_id"))
    return hits.join(_maybe_broadcast(named, small), "window_id").select("rid", "start", "length", "item_id")


def _near(index: Index, listed: DataFrame, windows: DataFrame, *, within: int, rarest: int) -> DataFrame:
    """``rid, item_id, start, end``: places where the ``rarest`` terms of an item's window stand, in any order, in at most ``within`` words.

    A match ends at each posting that completes a set; its start is the latest that the other terms allow.
    """
    probes = index.probes(windows, rarest)
    placed = index.postings.join(_maybe_broadcast(probes, index.small), "term").select("rid", "window_id", "place", "pos")
    before = Window.partitionBy("rid", "window_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("place") == k, F.col("pos"))).over(before) for k in range(1, rarest + 1)]
    needed = probes.groupBy("window_id").agg(F.max("place").alias("needed"))
    rows = placed.select("rid", "window_id", "pos", *(x.alias(f"last{k}") for k, x in enumerate(last, 1))).join(_maybe_broadcast(needed, index.small), "window_id")
    known = [F.when(F.col("needed") >= k, F.coalesce(f"last{k}", F.lit(-(2**30)))).otherwise(F.col("pos")) for k in range(1, rarest + 1)]
    first = F.least(*known) if len(known) > 1 else known[0]
    near = rows.select("rid", "window_id", first.alias("start"), F.col("pos").alias("end")).where(F.col("end") - F.col("start") < within)
    named = listed.select("item_id", F.xxhash64(F.concat_ws(" ", "words")).alias("window_id"))
    return near.join(_maybe_broadcast(named, index.small), "window_id").select("rid", "item_id", "start", "end").distinct()


def proximity(documents: DataFrame, items: DataFrame, *, within: int = WITHIN, rarest: int = NEAR_TERMS, size: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, item_id, start, end``: where the rarest terms of an item's windows stand near each other."""
    listed = stored(windows_of(items, size=size), "windows")
    windows, small = _numbered(listed)
    index = Index(documents, windows, small)
    return _near(index, listed, windows, within=within, rarest=rarest).join(index.split.select("rid", "doc_id"), "rid").select("doc_id", "item_id", "start", "end")


def decontaminate(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of phrase matches, and ``n_near``, the items that are near, for every document."""
    listed = stored(windows_of(items), "windows")
    windows, small = _numbered(listed)
    index = Index(documents, windows, small, doc_id=doc_id, text=text)
    found = stored(occurrences(index, listed, windows), "occurrences")
    near = stored(_near(index, listed, windows, within=WITHIN, rarest=NEAR_TERMS).groupBy("rid").agg(F.countDistinct("item_id").alias("n_near")), "near")
    index.drop()
    places = found.groupBy("rid", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    hit = places.select("rid", covered.alias("n")).groupBy("rid").agg(F.sum("n").alias("n_hit"))
    names = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    marks = stored(hit.join(names, "rid").join(near, "rid", "full"), "marks")
    out = index.split.select("rid", "doc_id", "n_words").join(marks, "rid", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` in which no window of an item stands; a text that is hit goes wherever it stands."""
    listed = stored(windows_of(items), "windows")
    windows, small = _numbered(listed)
    index = Index(documents, windows, small, doc_id=doc_id, text=text, digest=True)
    hit = occurrences(index, listed, windows).select("rid").distinct()
    digests = stored(index.split.select("rid", "digest").join(hit, "rid").select(F.col("digest").alias("_hit")).distinct(), "hit-texts")
    index.drop()
    dropped(index.split)
    return documents.join(digests, F.sha2(F.col(text), 256) == F.col("_hit"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "op7_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item_id, list_slice(w, i, i + {WINDOW_WORDS - 1}) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW_WORDS - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM v),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
o AS MATERIALIZED (SELECT g.doc_id, g.s, g.n, v.item_id FROM g JOIN v ON list_slice(g.w, g.s, g.s + g.n - 1) = v.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1)
, f AS MATERIALIZED (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) x GROUP BY 1),
t AS MATERIALIZED (SELECT win, term, place, max(place) OVER (PARTITION BY win) AS needed FROM (SELECT win, term, row_number() OVER (PARTITION BY win ORDER BY n, term) AS place, min(n) OVER (PARTITION BY win) AS least FROM (SELECT win, term, coalesce(n, 0) AS n FROM (SELECT DISTINCT win, unnest(win) AS term FROM v) y LEFT JOIN f USING (term)) z) q WHERE place <= {NEAR_TERMS} AND least > 0),
m AS (SELECT doc_id, win, needed, pos, max(CASE WHEN place = 1 THEN pos END) OVER p AS l1, max(CASE WHEN place = 2 THEN pos END) OVER p AS l2, max(CASE WHEN place = 3 THEN pos END) OVER p AS l3
  FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d) x JOIN t USING (term) WINDOW p AS (PARTITION BY doc_id, win ORDER BY pos)),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT DISTINCT doc_id, win FROM m WHERE pos - least(coalesce(l1, -999999), CASE WHEN needed >= 2 THEN coalesce(l2, -999999) ELSE pos END, CASE WHEN needed >= 3 THEN coalesce(l3, -999999) ELSE pos END) < {WITHIN}) x JOIN v USING (win) GROUP BY 1)
SELECT d.doc_id, coalesce(n_near, 0) AS n_near, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op7_decontamination": op7_decontamination}
