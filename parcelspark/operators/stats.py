"""Averages, groups, histograms, trends and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import kept


def kpis(df: DataFrame, values: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.round(F.avg(v), 2).alias(f"avg_{v}") for v in values])


def by_zip(df: DataFrame, values: list[str]) -> DataFrame:
    """Number of the first value, and averages of all, per zip code."""
    return df.where("zip_code is not null").groupBy("zip_code").agg(F.count(values[0]).alias("n"), *[F.round(F.avg(v), 2).alias(f"avg_{v}") for v in values])


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Count per bin of equal width between least and greatest value; empty bins are there with 0."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"))
    edge = known.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * bins), F.lit(0))
    counts = known.crossJoin(F.broadcast(edge)).select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = edge.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), (F.col("high") - F.col("low")).alias("span"), "low")
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("low") + F.col("span") * F.col("bin") / bins, 4).alias("from_value"), F.coalesce("n", F.lit(0)).alias("n"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x over rows that have both."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.regr_count(F.col(y), F.col(x)).alias("n"))


def loess(df: DataFrame, date: str, value: str, points: int = 24, bandwidth: float = 0.3) -> DataFrame:
    """Local linear regression of a value on days, at ``points`` evenly spaced days, with tricube weights.

    Values are first summed per day, so the range join is days x points however many rows there are. ``bandwidth`` is a share of the whole range.
    """
    days = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).groupBy(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("day")) \
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    edge = days.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    grid = edge.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "low", "high") \
        .select("point", (F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / float(points - 1)).alias("x0"), ((F.col("high") - F.col("low")) * F.lit(bandwidth)).alias("h"))
    near = days.join(F.broadcast(grid), F.abs(F.col("day") - F.col("x0")) < F.col("h"))  # `points` rows
    u = F.col("day") - F.col("x0")
    w = F.pow(1 - F.pow(F.abs(u) / F.col("h"), 3), 3)
    near = near.select("point", "x0", u.alias("u"), (w * F.col("n")).alias("wn"), (w * F.col("total")).alias("wy"))
    sums = near.groupBy("point", "x0").agg(F.sum("wn").alias("s0"), F.sum(F.col("wn") * F.col("u")).alias("s1"), F.sum(F.col("wn") * F.col("u") * F.col("u")).alias("s2"),
                                           F.sum("wy").alias("t0"), F.sum(F.col("wy") * F.col("u")).alias("t1"))
    fitted = F.coalesce(F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")), F.try_divide(F.col("t0"), F.col("s0")))
    return sums.select("point", F.round("x0", 3).alias("day"), F.round(fitted, 3).alias("fitted"))


def _after(rows: DataFrame, table: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the first row of ``table`` whose ``at`` is at least ``key``; both are small. One sorted run instead of a range join."""
    both = rows.withColumns({"__k": F.col(key).cast("double"), "__t": F.lit(0), "__v": F.lit(None).cast(dict(table.dtypes)[value])}) \
        .unionByName(table.select(F.col(at).cast("double").alias("__k"), F.lit(1).alias("__t"), F.col(value).alias("__v")), allowMissingColumns=True)
    w = W.orderBy("__k", "__t", "__v").rowsBetween(0, W.unboundedFollowing)
    return both.withColumn(value, F.first("__v", True).over(w)).where("__t = 0").drop("__k", "__t", "__v")


def lower_median(rows: DataFrame, value: str, times: str) -> DataFrame:
    """``m``: the lower median of a value of at least 0 that counts ``times`` times in each row; exact.

    Counts of bins a few thousandths of their values wide tell which bin has it, so only that bin's different values are sorted. Both sorts are of one task, of bins and of a bin's values.
    """
    rows = rows.select(F.col(value).alias("v"), F.col(times).alias("n")).withColumn("bin", F.when(F.col("v") > 0, F.floor(F.ln("v") * 512)).otherwise(F.lit(-(2**62))))
    upto = W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    bins = rows.groupBy(F.col("bin").alias("at")).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(W.partitionBy()))
    place = bins.where(2 * F.col("upto") >= F.col("size")).agg(F.min(F.struct("at", (F.col("upto") - F.col("n")).alias("before"), "size")).alias("p")).select("p.*")
    inside = rows.join(F.broadcast(place), F.col("bin") == F.col("at")).groupBy("v").agg(F.sum("n").alias("n"), F.max("before").alias("before"), F.max("size").alias("size"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    return inside.where(2 * F.col("upto") >= F.col("size")).agg(F.min("v").alias("m"))


def lowess(df: DataFrame, date: str, value: str, share: float = 2 / 3, rounds: int = 3) -> DataFrame:
    """``day, fitted``: robust local linear regression on days (since 1970), at every day that has a value.

    The neighbourhood of a day is the ``share`` of all rows nearest to it: k rows in a row in the order of days, found from running counts per day. Weights fall as (1 - d^3)^3 with the distance in parts of the
    farthest neighbour's; a day that the neighbourhood cuts counts by the part that is inside. Then ``rounds`` times rows weigh (1 - u^2)^2 by their residual u in parts of six (lower) medians, 0 from 0.999 on and 1 up to
    0.001, and the fit is repeated. Equal values of a day have equal residuals, so they are one row with a count from the beginning on. Rows are summed per day in every round; what is joined and sorted beyond that has a row per day,
    or per two days near to each other, or is a part of the medians. Runs jobs: rows, days and each fit are written.
    """
    rows = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).select(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("day"), F.col(value).cast("double").alias("y"))
    rows = kept(rows.groupBy("day", "y").agg(F.count("*").alias("times")), "lowess-rows")
    order = W.orderBy("day")
    days = rows.groupBy("day").agg(F.sum("times").alias("n")).withColumn("upto", F.sum("n").over(order)).withColumn("nth", F.row_number().over(order))  # a row for each day
    days = kept(days.withColumn("start", F.col("upto") - F.col("n")).withColumn("last", F.col("upto") - 1), "lowess-days")
    size = days.agg(F.max("upto")).first()[0]
    if not size:
        return days.select("day", F.lit(None).cast("double").alias("fitted"))
    k = max(1, int(share * size + 1e-10))
    # the first row of the neighbourhood changes only where it, or the row after the last one, comes to another day
    cuts = days.select(F.explode(F.array("start", F.col("upto") - k, F.col("start") - k, F.lit(0).cast("bigint"), F.lit(size - k).cast("bigint"))).alias("first")).where(F.col("first").between(0, size - k)).distinct()
    cuts = _after(cuts, days.select("last", F.col("day").alias("low")), "first", "last", "low").withColumn("beyond", F.col("first") + k)
    cuts = _after(cuts, days.select("last", F.col("day").alias("high")), "beyond", "last", "high")
    cuts = cuts.select("first", F.when(F.col("first") == size - k, float("inf")).otherwise(F.col("low") + F.col("high")).alias("twice"))
    near = _after(days.select("day", (2 * F.col("day")).alias("twice_day")), cuts, "twice_day", "twice", "first").withColumn("end", F.col("first") + k - 1)
    near = _after(near, days.select("last", F.struct("nth", "day").alias("a")), "first", "last", "a")
    near = _after(near, days.select("last", F.struct("nth", "day").alias("b")), "end", "last", "b")
    radius = F.greatest(F.col("day") - F.col("a.day"), F.col("b.day") - F.col("day"))
    near = near.select(F.col("day").alias("x0"), "first", "end", radius.alias("h"), F.explode(F.sequence("a.nth", "b.nth")).alias("nth")).join(days, "nth")
    inside = (F.least("end", "last") - F.greatest("first", "start") + 1) / F.col("n")
    u = F.col("day") - F.col("x0")
    w = F.when(F.col("h") == 0, 1.0).otherwise(F.pow(1 - F.pow(F.abs(u) / F.col("h"), 3), 3)) * inside
    near = kept(near.select("x0", "day", u.cast("double").alias("u"), w.alias("w")), "lowess-near")
    weighed, fits = rows.withColumn("r", F.lit(1.0)), None
    for step in range(rounds + 1):
        sums = weighed.groupBy("day").agg(F.sum(F.col("r") * F.col("times")).alias("rn"), F.sum(F.col("r") * F.col("y") * F.col("times")).alias("ry"))
        each = near.join(sums, "day").select("x0", "u", (F.col("w") * F.col("rn")).alias("a"), (F.col("w") * F.col("ry")).alias("b"))
        each = each.groupBy("x0").agg(F.sum("a").alias("s0"), F.sum(F.col("a") * F.col("u")).alias("s1"), F.sum(F.col("a") * F.col("u") * F.col("u")).alias("s2"), F.sum("b").alias("t0"), F.sum(F.col("b") * F.col("u")).alias("t1"))
        spread = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = F.when(spread > 1e-9 * F.col("s0") * F.col("s0"), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / spread)
        fits = kept(each.select(F.col("x0").alias("day"), F.coalesce(line, F.try_divide("t0", "s0")).alias("fitted")), "lowess-fit")
        if step < rounds:
            off = rows.join(fits, "day").withColumn("off", F.abs(F.col("y") - F.coalesce("fitted", "y")))
            median = lower_median(off, "off", "times")
            off = off.crossJoin(F.broadcast(median)).withColumn("part", F.when(F.col("m") == 0, F.when(F.col("off") > 0, 1.0).otherwise(0.0)).otherwise(F.col("off") / (6 * F.col("m"))))
            weighed = off.select("day", "y", "times", F.when(F.col("part") >= 0.999, 0.0).when(F.col("part") <= 0.001, 1.0).otherwise(F.pow(1 - F.col("part") * F.col("part"), 2)).alias("r"))
    return fits


def transposed(df: DataFrame, fields: list[str], labels: list[str], label: str = "label") -> DataFrame:
    """Fields as rows, properties as columns; ``labels`` are the few properties compared."""
    tall = df.select(label, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([label], fields, "field", "value")
    return tall.groupBy("field").pivot(label, labels).agg(F.first("value"))
