"""Header detection, split headers, header names, column profiles and file classes, over a table of cells of many files.

Every step is keyed by file, so files of any shape share one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import PLACEHOLDERS, parse_date, parsed

# Words of a header row, rows looked at, least score, words that mark a file's kind, sample sizes.
KEYWORDS = ["address", "city", "tenant", "buyer", "seller", "date", "price", "sqft", "size", "rate", "term", "commencement", "lessee", "sf", "psf", "rent", "building", "property", "lease", "cap", "closing", "year", "type",
            "height", "notes", "acres", "acreage", "submarket", "class", "vintage", "structure", "nnn", "gross", "transaction", "sale", "landlord", "occupant"]
LEASE_TRIGGERS = ["tenant", "lessee", "term", "commencement", "base rent", "rent", "leased", "free rent", "escalation", "opex", "base rate", "lease type", "signed date", "rate type", "ti allowance", "ti", "abatement"]
SALE_TRIGGERS = ["buyer", "seller", "closing", "cap rate", "purchase", "sale price", "deal", "transaction", "sale date", "price per sf", "acreage", "purchase price"]
LEASE_NAMES, SALE_NAMES = ["lease", "leasing", "tenant"], ["sale", "sold", "transaction", "purchase"]
PROBE_ROWS, LEAST_SCORE, SAMPLE, DATE_SAMPLE = 30, 2, 20, 8
FILE = "file_no"


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def row_texts(cells: DataFrame) -> DataFrame:
    """One row per file and row: its cells joined by spaces, and how many are not blank."""
    by_col = F.sort_array(F.collect_list(F.struct("col_idx", "value")))
    return cells.groupBy(FILE, "row_idx").agg(by_col.alias("c"), F.count_if(F.trim("value") != "").alias("filled")) \
        .select(FILE, "row_idx", "filled", F.array_join(F.transform("c", lambda x: x["value"]), " ").alias("text"))


def header_rows(cells: DataFrame) -> DataFrame:
    """``file_no, header_row, score, found``: the first row with the most keywords; row 0 where that is too few."""
    rows = row_texts(cells.where(F.col("row_idx") < PROBE_ROWS)).withColumn("score", hits(F.lower("text"), KEYWORDS))
    best = rows.groupBy(FILE).agg(F.max(F.struct("score", F.negative("row_idx").alias("up"))).alias("b"))
    found = F.col("b.score") >= LEAST_SCORE
    return best.select(FILE, F.when(found, F.negative("b.up")).otherwise(0).cast("int").alias("header_row"), F.col("b.score").alias("score"), found.alias("found"))


def looks_like_data(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.contains(text, F.lit("$")) | text.rlike(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}") | F.coalesce(F.try_divide(digits, F.length(text)) > 0.3, F.lit(False))


def headers(cells: DataFrame) -> DataFrame:
    """``file_no, col_idx, header, data_row``: names after joining up to two sub-header rows and numbering repeated names; data starts at ``data_row``."""
    top = header_rows(cells)
    near = cells.join(top, FILE).where((F.col("row_idx") >= F.col("header_row")) & (F.col("row_idx") <= F.col("header_row") + 2)).withColumn("down", F.col("row_idx") - F.col("header_row"))
    # a file is as wide as its widest row
    wide = cells.groupBy(FILE).agg((F.max("col_idx") + 1).alias("width"))
    rows = row_texts(near.select(FILE, F.col("down").alias("row_idx"), "col_idx", "value")).join(wide, FILE)
    joins = (F.col("filled") > F.col("width") * 0.3) & ~looks_like_data(F.col("text"))
    first = F.max(F.when(F.col("row_idx") == 1, joins))
    second = F.max(F.when(F.col("row_idx") == 2, joins))
    subs = rows.groupBy(FILE).agg(F.coalesce(first, F.lit(False)).alias("one"), F.coalesce(second, F.lit(False)).alias("two")).join(top, FILE)
    subs = subs.select(FILE, F.when(~F.col("found") | ~F.col("one"), 0).when(F.col("two"), 2).otherwise(1).alias("subs"), "header_row", "found").join(wide, FILE)
    grid = subs.withColumn("col_idx", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))))
    parts = near.groupBy(FILE, "col_idx").agg(*[F.max(F.when(F.col("down") == i, F.trim("value"))).alias(f"h{i}") for i in range(3)])
    grid = grid.join(parts, [FILE, "col_idx"], "left")
    merged = F.concat_ws(" ", F.when(~F.contains("h0", F.lit("Unnamed")), F.nullif("h0", F.lit(""))), F.when(F.col("subs") >= 1, F.nullif("h1", F.lit(""))), F.when(F.col("subs") >= 2, F.nullif("h2", F.lit(""))))
    plain = F.coalesce("h0", F.concat(F.lit("Unnamed: "), F.col("col_idx")))
    name = F.when(F.col("subs") == 0, plain).otherwise(F.coalesce(F.nullif(merged, F.lit("")), F.lit("Unknown")))
    named = grid.select(FILE, "col_idx", name.alias("name"), "found", (F.col("header_row") + 1 + F.col("subs")).alias("data_row"))
    nth = F.row_number().over(W.partitionBy(FILE, "name").orderBy("col_idx"))
    return named.withColumn("nth", nth).select(FILE, "col_idx", F.when(F.col("found") & (F.col("nth") > 1), F.concat("name", F.lit("_"), "nth")).otherwise(F.col("name")).alias("header"), "data_row")


def data_cells(cells: DataFrame, names: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Cells of the rows below the header, at most ``max_rows`` rows of a file (rows without cells do not count)."""
    rows = cells.join(names.select(FILE, "data_row").distinct(), FILE).where(F.col("row_idx") >= F.col("data_row")).drop("data_row")
    if max_rows is None:
        return rows
    first = rows.select(FILE, "row_idx").distinct().withColumn("nth", F.row_number().over(W.partitionBy(FILE).orderBy("row_idx"))).where(F.col("nth") <= max_rows)
    return rows.join(first.drop("nth"), [FILE, "row_idx"], "left_semi")


def profiles(data: DataFrame) -> DataFrame:
    """``file_no, col_idx, profile``: numeric_money, numeric_clean, date, text or empty, from a column's first values."""
    w = W.partitionBy(FILE, "col_idx").orderBy("row_idx")
    rows = data.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= SAMPLE)
    rows = rows.withColumn("kept", ~F.trim("value").isin([p for p in PLACEHOLDERS if p.lower() != "tbd"]))
    rows = rows.withColumn("seq", F.sum(F.col("kept").cast("int")).over(w))
    bare = F.trim(F.regexp_replace("value", "[$,%]", ""))
    number = parsed(bare).isNotNull() | F.trim("value").rlike(r"^[\d,.]+\s*/\s*\w+")
    date = parse_date(F.col("value")).isNotNull() & F.col("value").rlike("[/,-]")
    per = rows.groupBy(FILE, "col_idx").agg(F.count_if("kept").alias("n"), F.count_if(F.col("kept") & number).alias("numbers"), F.count_if(F.col("kept") & (F.col("seq") <= DATE_SAMPLE) & date).alias("dates"),
                                            F.max(F.when(F.col("kept"), F.contains("value", F.lit("$")))).alias("money"))
    numeric = F.col("numbers") / F.col("n") > 0.5
    kind = F.when(F.col("n") == 0, "empty").when(numeric & F.col("money"), "numeric_money").when(numeric, "numeric_clean").when(F.col("dates") >= 2, "date").otherwise("text")
    return per.select(FILE, "col_idx", kind.alias("profile"))


def file_classes(names: DataFrame, file_name: Column | None = None, word_boundary: bool = False) -> DataFrame:
    """``file_no, lease_score, sale_score, kind``. A trigger counts by being contained in a header, or as whole words with ``word_boundary``."""
    low = F.lower(F.trim("header"))

    def has(words: list[str]) -> Column:
        return low.rlike(r"\b(" + "|".join(words) + r")\b") if word_boundary else hits(low, words) > 0

    per = names.groupBy(FILE).agg(F.count_if(has(LEASE_TRIGGERS)).alias("lease_score"), F.count_if(has(SALE_TRIGGERS)).alias("sale_score"))
    if file_name is not None:
        name = F.lower(file_name)
        per = per.withColumn("lease_score", F.col("lease_score") + F.when(hits(name, LEASE_NAMES) > 0, 10).otherwise(0)).withColumn("sale_score", F.col("sale_score") + F.when(hits(name, SALE_NAMES) > 0, 10).otherwise(0))
    kind = F.when(F.col("lease_score") > F.col("sale_score"), "LEASE").when(F.col("sale_score") > F.col("lease_score"), "SALE").when(F.col("lease_score") > 0, "BOTH").otherwise("UNKNOWN")
    return per.withColumn("kind", kind)
