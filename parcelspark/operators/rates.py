"""Monthly and annual rent: the unit from a header or from the level of a file's rates, and the split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a header says about the unit (monthly is looked for first), and the rate up to which a file counts as monthly.
MONTHLY = ["monthly", "/mo", "per month", " mo ", " mo.", "psf/mo", "per sf per month", "$/sf/mo", "per mo", "/month", "per sf/mo"]
ANNUAL = ["annual", "yearly", "/yr", "per year", " yr ", " yr.", "annually", "psf/yr", "per sf per year", "$/sf/yr", "per annum", "/year", "per sf/yr", "p.a.", "nnn/sf/yr", "per acre per year"]
THRESHOLD = 4.0


def _any(words: list[str]) -> str:
    return "|".join(re.sub(r"([.$/])", r"\\\1", w) for w in words)


def unit_from_header(header: Column) -> Column:
    h = F.lower(header)
    return F.when(h.rlike(_any(MONTHLY)), "monthly").when(h.rlike(_any(ANNUAL)), "annual")


def upper_median(rates: DataFrame, group: str, value: str) -> DataFrame:
    """Per group, the value at index n / 2 (rounded down) of the sorted positive values: an element, never a mean of two.

    Values are counted first, so what is ordered is one row per distinct value of a group.
    """
    counts = rates.where(F.col(value) > 0).groupBy(group, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(group)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    return counts.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(group).agg(F.min(value).alias("upper_median"))


def split_rate(rate: Column, unit: Column) -> tuple[Column, Column, Column]:
    """Monthly rate, annual rate and basis."""
    monthly = F.when(unit == "monthly", F.round(rate, 2)).when(unit == "annual", F.round(rate / 12, 2))
    annual = F.when(unit == "monthly", F.round(rate * 12, 2)).when(unit == "annual", F.round(rate, 2))
    return monthly, annual, F.when(rate.isNotNull(), F.concat(unit, F.lit("_from_header")))


def with_rates(rows: DataFrame, group: str, rate: str = "rate_psf", header: str = "rate_header", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``rate_monthly, rate_annually, rate_basis``. Without a hint in the header a file takes one unit by its upper median; files
    without positive rates take it row by row."""
    levels = upper_median(rows.where(unit_from_header(F.col(header)).isNull()), group, rate)
    rows = rows.join(levels, group, "left")
    hint = unit_from_header(F.col(header))
    whole = F.when(F.col("upper_median") <= threshold, "monthly").when(F.col("upper_median").isNotNull(), "annual")
    by_row = F.when(F.col(rate) <= threshold, "monthly").otherwise("annual")
    monthly, annual, basis = split_rate(F.col(rate), F.coalesce(hint, whole, by_row))
    basis = F.when(F.coalesce(hint, whole).isNotNull(), basis).otherwise(F.when(F.col(rate).isNotNull(), F.concat(by_row, F.lit("_inferred"))))
    return rows.withColumns({"rate_monthly": monthly, "rate_annually": annual, "rate_basis": basis}).drop("upper_median")


def fill_price_per_sf(price: Column, size: Column, psf: Column) -> Column:
    return F.coalesce(psf, F.round(F.try_divide(price, size), 2))
