"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, DataFrame functions only.

A window is ``window`` consecutive words of an item (an item of fewer words is one window). A window is a set of word
shingles at known offsets, all of which must occur in a document that contains it, so a prefix of one shingle is enough to find it:
the one in the fewest documents. The join goes in three steps:

1. One pass over the documents keeps the places where any benchmark shingle occurs, with the words around each place.
   Every document also carries an entry for a sentinel, which brings its word count along.
2. Shingles are ordered by rarity over all documents, and each window is indexed under its rarest shingle alone.
3. Places are joined with that index; the window must start inside the document (positional bound) and end inside it
   (length bound), and its words must equal the words around the place exactly.

The shingles of a benchmark of up to ``broadcast_rows`` shingles are broadcast, a bound that is checked by counting; a larger
one is joined by shuffling narrow rows (key, place, nearby words). Nothing is collected but the shingle lengths in use,
of which there are five at most.

Defined results: null or empty texts have no words, no hits, and items without words match nothing. Repeated documents
each get their row. Rows of the benchmark with the same id are one item; a null id is an item named ``null``. An empty benchmark
or documents table gives no hits or no rows. Windows and places are written to the shared folder while the plan is made. Further columns are ignored by ``leaks`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_words, free_names, row_key, written

SENTINEL = 0


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _windows(items: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """``item, start, size, win``: every window of every item."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), ascii_words(F.col(item_text)).alias("w"))
    words = words.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    return words.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size")))) \
        .select("item", "size", F.slice("w", F.col("start") + 1, F.col("size")).alias("win")).distinct()


def leaks(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document: ``id, key, n_words, n_hit, items`` (the sorted ids of the items with a window in it)."""
    wins = written(_windows(items, window, item_id, item_text), "leak-windows")
    lengths = sorted(r[0] for r in wins.select(F.least("size", F.lit(shingle))).distinct().collect())
    grams = wins.sparkSession.createDataFrame([], "item string, size int, win array<string>, h bigint, offset int")
    for k in lengths:
        grams = grams.union(wins.where(F.least("size", F.lit(shingle)) == k)
                            .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - k)))
                            .select("item", "size", "win", _shingle(F.col("win"), F.col("offset"), k).alias("h"), "offset"))
    probes = grams.select("h").union(grams.sparkSession.range(1).select(F.lit(SENTINEL).cast("bigint").alias("h"))).distinct()
    small = probes.count() <= broadcast_rows

    # position 0 holds the sentinel, position p the p-th word
    docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.concat(F.array(F.lit("")), ascii_words(F.col(text_col))).alias("w"))
    places = docs.select("id", "key", "w", (F.size("w") - 1).alias("n_words"), F.posexplode("w").alias("pos", "_")).drop("_")
    sentinel = F.when(F.col("pos") == 0, F.lit(SENTINEL).cast("bigint"))
    hashes = [sentinel.when(F.col("pos") + k <= F.size("w"), _shingle(F.col("w"), F.col("pos"), k)) for k in lengths] or [sentinel]
    places = places.withColumn("h", hashes[0] if len(hashes) == 1 else F.explode(F.array_distinct(F.array(*hashes))))
    first = F.greatest(F.col("pos") - (window - 1), F.lit(1))
    near = F.when(F.col("pos") > 0, F.slice("w", first + 1, 2 * window - 1)).alias("near")
    narrow = ["id", "key", "n_words", "pos", "h"]
    found = places.join(F.broadcast(probes), "h").select(*narrow, near) if small else places.where("h is not null").select(*narrow, near).join(probes, "h")
    found = written(found, "leak-places")

    rarity = found.where("pos > 0").groupBy("h").agg(F.countDistinct("key").alias("docs"))
    index = grams.join(rarity, "h").groupBy("item", "size", "win").agg(F.count("*").alias("present"), F.min(F.struct("docs", "h", "offset")).alias("rare"))
    # a window with a shingle in no document occurs nowhere
    index = index.where(F.col("present") == F.col("size") - F.least("size", F.lit(shingle)) + 1).select("item", "size", "win", "rare.h", "rare.offset")
    start = F.col("pos") - F.col("offset")
    hits = found.where("pos > 0").join(index, "h").withColumn("start", start).withColumn("first", first) \
        .where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n_words"))) \
        .where(F.slice("near", F.col("start") - F.col("first") + 1, F.col("size")) == F.col("win"))
    hits = hits.select("key", "item", "start", (F.col("start") + F.col("size")).alias("end"))
    spans = hits.groupBy("key", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    covered = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.where("pos = 0").select("id", "key", F.col("n_words").cast("long").alias("n_words")) \
        .join(covered.join(named, "key"), "key", "left") \
        .select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns."""
    key = free_names(docs, "key")[0]
    bad = leaks(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(bad, key, "left_anti").select(*docs.columns)
