"""CSV and KML export, written by Spark as part files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str) -> None:
    """Part files with a header each; quotes are doubled, and cells with separators, quotes or line breaks are quoted."""
    df.write.option("header", True).option("escape", '"').csv(path)


def _escaped(c: Column) -> Column:
    return reduce(lambda a, x: F.replace(a, F.lit(x[0]), F.lit(x[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], c)


def placemark(size: Column, price: Column) -> Column:
    """A KML fragment; null without both coordinates."""
    amount = lambda c: F.coalesce(F.floor(c).cast("bigint").cast("string"), F.lit("N/A"))
    text = F.concat(F.lit("<Placemark><name>"), _escaped(F.coalesce("address", F.lit(""))), F.lit("</name><description>Size: "), amount(size), F.lit(", Price: "), amount(price),
                    F.lit("</description><Point><coordinates>"), F.round("longitude", 6).cast("decimal(12,6)"), F.lit(","), F.round("latitude", 6).cast("decimal(12,6)"), F.lit(",0</coordinates></Point></Placemark>"))
    return F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), text)


def to_kml_parts(df: DataFrame, path: str, size: Column, price: Column) -> None:
    """Fragments as text parts, to be put between a header and a footer."""
    df.select(placemark(size, price).alias("value")).where("value is not null").write.text(path)


def popup(df: DataFrame) -> DataFrame:
    """The text shown at a marker; what is missing is left out."""
    part = lambda form, c: F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c)))
    return df.withColumn("popup", F.concat_ws(" | ", F.coalesce("address", F.lit("N/A")), part("$%,.0f", "sale_price"), part("%,.0f SF", "building_size"), part("%.1f mi", "distance_miles")))
