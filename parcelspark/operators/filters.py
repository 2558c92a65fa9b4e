"""Filters, options, ordering and pages over a property table: each is an expression or a lazy plan that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import kept

# Fixed value: rows of a page.
PAGE = 100


@dataclass(frozen=True)
class Filter:
    """One condition on a column. ``kind``: range, text, literal, any_of, dates or lexicographic_dates."""

    column: str
    kind: str
    low: object = None
    high: object = None
    values: tuple = ()

    def expression(self, df: DataFrame) -> Column | None:
        if self.column not in df.columns:
            return None  # a view without the column is not filtered by it
        c = F.col(self.column)
        if self.kind == "text":
            return c.cast("string").rlike(f"(?i){self.low}")
        if self.kind == "literal":
            return F.lower(c.cast("string")).contains(str(self.low).lower())
        if self.kind == "any_of":
            return c.cast("string").isin(*self.values)
        low, high = self.low, self.high
        if self.kind == "dates":
            c, low, high = c.cast("date"), *(None if x is None else F.lit(x).cast("date") for x in (low, high))
        elif self.kind == "lexicographic_dates":
            c = c.cast("string")
        bounds = ([] if low is None else [c >= low]) + ([] if high is None else [c <= high])
        return reduce(lambda a, b: a & b, bounds) if bounds else None


def filtered(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Rows that meet every filter; a missing value meets none that is active."""
    found = [e for e in (f.expression(df) for f in filters) if e is not None]
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank, in order."""
    return df.select(F.col(column).cast("string").alias("option")).where("trim(option) <> ''").distinct().orderBy("option")


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column, one row per column, in one pass."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").cast("double").alias("low"), F.col(f"max_{c}").cast("double").alias("high")) for c in columns])).alias("r")).select("r.*")


def ordered(df: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """Missing values last either way; the key breaks ties."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)


def positioned(df: DataFrame, column: str, descending: bool = False, key: str = "id") -> DataFrame:
    """``df`` with ``nth``, each row's position (from 1) in that order: rows are dealt by range and counted per part, so no task has them all."""
    c = F.col(column)
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)]
    parts = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "order-parts")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each part
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    rows = parts.withColumn("__nth", nth).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return rows.select(*df.columns, (F.col("__nth") + F.col("__before")).alias("nth"))


def page(df: DataFrame, column: str, number: int, descending: bool = False, size: int = PAGE, key: str = "id") -> DataFrame:
    """The page of that number; numbers beyond the ends give the first and last page."""
    pages = max(1, -(-df.count() // size))
    at = min(max(1, number), pages)
    return ordered(df, column, descending, key).offset((at - 1) * size).limit(size)


def page_after(df: DataFrame, column: str, last_value: object, last_key: object, size: int = PAGE, key: str = "id") -> DataFrame:
    """The page that follows a row, in ascending order: a filter and a top-k instead of an offset, for deep pages."""
    c = F.col(column)
    after = (c > last_value) | (c == last_value) & (F.col(key) > last_key) | c.isNull() if last_value is not None else c.isNull() & (F.col(key) > last_key)
    return ordered(df.where(after), column, key=key).limit(size)


def selected(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the given ids, with their labels."""
    return df.join(ids.select(key).distinct(), key, "left_semi").withColumn("label", F.concat(F.col(key), F.lit(": "), F.substring(F.coalesce("address", F.lit("")), 1, 60)))


def projected(df: DataFrame, first: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """Columns in order of priority, without hidden ones; absent ones are passed over."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead and c not in hidden])
