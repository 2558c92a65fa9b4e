"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share (by weight) of ``share`` times the whole size, held at ``cap`` times its own size, the excess
being shared again by weight. Within a source documents are wanted unequally: a document of size class k (its size is
from 2 ** k up to 2 ** (k + 1)) is wanted in proportion to 2 ** (``tilt`` * k), at most ``cap`` times, so that the source's
wanted words are its target. With the default tilt a document 16 times as long is wanted half as often, and a few very long documents do not
make up a source. The whole part of that number is certain copies; the rest is an inclusion probability p.

The random part is drawn by Pareto order sampling: documents are ranked by q = (u / (1 - u)) / (p / (1 - p)), u being
a uniform number made from the document's id and text, and the sample is the first of that order up to a fixed size, which is the source's
sum of p times size. The size is counted in words: the first documents whose sizes together stay within it are taken, and what is
left, less than the size of the next document, is filled from later ranks that fit (``rounds`` - 1 times). Then the document whose size is nearest to what is
still left is taken too, if the source ends nearer to its target with it. So a source ends within half the size of its smallest open document of its target, a little above or below.

Ranks are not sorted per source. Each source's q axis is cut into ``BINS`` bins, sizes are summed per bin, and only the one
bin in which the sum crosses the fixed size is ordered row by row; so a source with a third of all rows costs one task at
most about a ``BINS``-th of them, and the result is the same as that of a full sort. What is joined to the rows has a row for each source
and size class; it is broadcast if it has at most ``BROADCAST_ROWS`` rows, by count, and shuffled beyond.

Defined results: a null text has size 0; null sources are one source, ordered last; documents of size 0 take no words
but keep the certain copies of their source as a whole. Where all sizes are 0 every target is 0. u depends on id and text alone, so reruns agree
whatever the partitions; repeated rows share u and are interchangeable. An empty table gives an empty result. Further
columns are untouched, whatever their names. Each round is written to the shared folder while the plan is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, row_key, written

BINS = 4096
BROADCAST_ROWS = 100_000


def n_words(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.size(F.array_remove(F.split(F.coalesce(c.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def filled(rows: DataFrame, by: list[Column], total: Column, order: str) -> DataFrame:
    """``given``: the ``total`` of each group shared out by ``weight``, no row above its ``most``, the excess shared again.

    With rows ordered by most / weight, the common level is the first one that the next row's limit does not undercut.
    """
    rows = rows.withColumn("ratio", F.try_divide("most", "weight"))
    before = W.partitionBy(*by).orderBy("ratio", F.col(order).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*by)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    shared = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.try_divide(left, shared))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return rows.withColumn("given", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).drop("ratio", "level")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size, target``. There is one row per source here, so one small window orders them."""
    n, order = len(weights), W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    rows = sources.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    return filled(rows, [], total, "source").select("source", "source_size", F.col("given").alias("target"))


def wants(sizes: DataFrame, weights: Sequence[float], share: float, cap: float, tilt: float) -> DataFrame:
    """``source, class, source_size, target, wanted, fixed``: how often a document of a size class is wanted, and the words of the random part."""
    per_class = sizes.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    goal = targets(per_class.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, share, cap)
    rows = joined(per_class, goal, "source").withColumn("most", F.col("class_size") * F.lit(float(cap))) \
        .withColumn("weight", F.col("class_size") * F.pow(F.lit(2.0), F.col("class") * F.lit(float(tilt))))
    source = F.struct("source")  # a struct groups null sources like any other value
    rows = filled(rows, [source], F.col("target"), "class")
    rest = F.try_divide("target", F.col("source_size").cast("double"))
    rows = rows.withColumn("wanted", F.least(F.lit(float(cap)), F.coalesce(F.try_divide("given", F.col("class_size").cast("double")), rest, F.lit(0.0))))
    whole = F.round("wanted")  # a number that is whole but for rounding is whole: its documents are certain
    rows = rows.withColumn("wanted", F.when(F.abs(F.col("wanted") - whole) < 1e-9, whole).otherwise(F.col("wanted")))
    part = (F.col("wanted") - F.floor("wanted")) * F.col("class_size")
    return rows.withColumn("fixed", F.sum(part).over(W.partitionBy(source))).select("source", "class", "source_size", "target", "wanted", "fixed")


def joined(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key at most; null keys are keys. It is broadcast only if its count allows it."""
    small = table.count() <= BROADCAST_ROWS
    named = table.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [rows[k].eqNullSafe(named[f"of_{k}"]) for k in keys]
    return rows.join(F.broadcast(named) if small else named, on, how).drop(*[f"of_{k}" for k in keys])


def _sampled(state: DataFrame) -> DataFrame:
    """Fill each source's ``need`` from its untaken rows in the order of q. Adds ``now``: taken in this round."""
    source = F.struct("source")
    fits = F.col("q").isNotNull() & ~F.col("picked") & (F.col("size") > 0) & (F.col("size") <= F.col("need"))
    state = state.withColumn("bin", F.when(fits, F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")))
    per_bin = state.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("need").alias("need"))
    run = F.sum("bin_size").over(W.partitionBy(source).orderBy("bin"))
    crossed = per_bin.withColumn("upto", run).where("upto > need") \
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("edge"))
    found = joined(state, written(crossed, "mix-edges"), "source", how="left")
    edge = F.col("edge.bin")
    inner = found.where(F.col("bin").isNull() | edge.isNull() | (F.col("bin") != edge)) \
        .withColumn("now", F.col("bin").isNotNull() & (edge.isNull() | (F.col("bin") < edge)))
    upto = F.sum("size").over(W.partitionBy(source).orderBy("q", "key").rowsBetween(W.unboundedPreceding, 0))
    outer = found.where(F.col("bin") == edge).withColumn("now", F.col("edge.before") + upto <= F.col("need"))
    return inner.unionByName(outer).drop("edge", "bin")


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the key and seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, tilt: float = -0.25, seed: int = 7,
         rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``id, key, source, size, source_size, target, wanted, q, copies, taken``."""
    size = n_words(F.col(text_col))
    docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    docs = docs.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1))
    docs = written(docs.withColumn("nth", F.monotonically_increasing_id()), "mix-sizes")  # tells interchangeable rows apart
    want = written(wants(docs, weights, share, cap, tilt), "mix-wants")
    u, p = uniform(F.col("key"), seed), F.col("wanted") - F.floor("wanted")
    state = joined(docs, want, "source", "class").drop("class").withColumn("whole", F.floor("wanted")) \
        .withColumn("q", F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))) \
        .withColumnRenamed("fixed", "need").withColumn("picked", F.lit(False))
    for _ in range(rounds):
        state = written(_sampled(state).withColumn("picked", F.col("picked") | F.col("now")), "mix-round")
        took = written(state.where("now").groupBy("source").agg(F.sum("size").alias("got")), "mix-took")
        state = joined(state, took, "source", how="left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got", "now")
    off = F.abs(F.col("size") - F.col("need"))
    last = state.where(F.col("q").isNotNull() & ~F.col("picked") & (off < F.col("need"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "key", "nth")).alias("last"))
    state = joined(state, written(last, "mix-last"), "source", how="left").withColumn("picked", F.col("picked") | F.coalesce(F.col("nth") == F.col("last.nth"), F.lit(False)))
    copies = (F.col("whole") + F.col("picked").cast("int")).cast("long")
    return state.select("id", "key", "source", "size", "source_size", "target", "wanted", "q", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns. Of rows with the same id and text,
    which are interchangeable, the first ones get the larger numbers of copies."""
    key, total, n, times = free_names(docs, "key", "total", "n", "times")
    drawn = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options) \
        .groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(total), F.count("*").alias(n))
    rows = docs.withColumn(key, row_key(id_col, text_col)).join(drawn, key)
    nth = F.row_number().over(W.partitionBy(key).orderBy(total))
    rows = rows.withColumn(times, (F.floor(F.col(total) / F.col(n)) + (nth <= F.col(total) % F.col(n)).cast("int")).cast("long")).where(F.col(times) > 0)
    return rows.withColumn(total, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
