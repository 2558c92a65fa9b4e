"""Directories of irregular CSV files as one table of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import spread

#: Spellings that a spreadsheet reader takes for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: A running state is taken over 2 ** this lines at a time.
LINES = 16

#: What follows an opening quote, up to the closing one; a field as a whole; and the fields of a line before the last one.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
_FIELD = f'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_BEFORE = f"(?:{_FIELD},)*+"
_OPEN = f'"{_QUOTED}$'


def _ends_open(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of a line that begins inside or outside of one."""
    return line.rlike(f'^{_QUOTED}(?:$|"[^,]*+,{_BEFORE}{_OPEN})' if inside else f"^{_BEFORE}{_OPEN}")


def _state(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``open``, the state after each row if the first row of its group begins outside, and ``open_if``, the same if it begins inside; rows have ``out`` and ``in_``, the state after them for either state before.

    A row either sets the state (both the same), keeps it or turns it over, so the state is that of the last row that set it, turned over as often as rows since then did.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    turns = F.sum((F.col("out") & ~F.col("in_")).cast("int")).over(w)
    lines = lines.withColumn("turns", turns)
    odd = F.col("turns") % 2 == 1
    lines = lines.withColumn("set", F.last(F.when(F.col("out") == F.col("in_"), F.col("out") != odd), True).over(w))
    return lines.withColumns({"open": F.coalesce("set", F.lit(False)) != odd, "open_if": F.coalesce("set", F.lit(True)) != odd}).drop("turns", "set")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file_no, row_idx, record``: the records of every file that are not blank, in order; a quoted cell may hold line breaks, and a quote within a cell that does not begin with one is a character like others.

    Files are read by lines, once and in byte ranges, so one large file is many tasks. Whether a line begins inside a quoted cell is a running state: within a range of at most 2 ** ``LINES`` lines by a window over it,
    which holds a range in memory, and across ranges by one over the few ranges of each file. Only records of several lines are gathered. Lines end with a line feed, with or without a carriage return.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file_no"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.struct("block", F.shiftright("at", LINES).alias("nth"))).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    # adaptive execution would bring lines together into as few tasks as there are cores, whatever their number
    lines = spread(lines, "file_no", "block")
    bare = F.regexp_replace("value", "\r$", "")
    lines = lines.withColumns({"out": _ends_open(bare, False), "in_": _ends_open(bare, True), "blank": bare == ""})
    lines = _state(lines, ["file_no", "block"], "at")
    w = W.partitionBy("file_no", "block").orderBy("at")
    before = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    lines = lines.withColumns({"begins": ~before("open", False) & ~F.col("blank"), "begins_if": ~before("open_if", True) & ~F.col("blank"), "was": before("open", False), "was_if": before("open_if", True)})
    ranges = lines.groupBy("file_no", "block").agg(F.max_by("open", "at").alias("out"), F.max_by("open_if", "at").alias("in_"), F.count_if("begins").alias("n"), F.count_if("begins_if").alias("n_if"))
    of_file = W.partitionBy("file_no").orderBy("block")
    ranges = _state(ranges, ["file_no"], "block").withColumn("inside", F.coalesce(F.lag("open").over(of_file), F.lit(False)))
    n = F.when(F.col("inside"), F.col("n_if")).otherwise(F.col("n"))
    ranges = ranges.withColumn("earlier", F.coalesce(F.sum(n).over(of_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("file_no", "block", "inside", "earlier")
    lines = lines.join(ranges, ["file_no", "block"])
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}_if")).otherwise(F.col(name))
    lines = lines.select("file_no", "block", "at", "value", "earlier", pick("begins").alias("begins"), pick("open").alias("open"), pick("was").alias("was"))
    lines = lines.withColumn("row_idx", F.col("earlier") + F.sum(F.col("begins").cast("int")).over(w) - 1).where(F.col("begins") | F.col("was"))
    lines = lines.withColumn("value", F.when(F.col("open"), F.col("value")).otherwise(F.regexp_replace("value", "\r$", "")))
    whole = lines.where(F.col("begins") & ~F.col("open")).select("file_no", "row_idx", F.col("value").alias("record"))
    parts = spread(lines.where(~F.col("begins") | F.col("open")), "file_no", "row_idx").groupBy("file_no", "row_idx").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    return whole.unionByName(parts.select("file_no", "row_idx", F.array_join("parts.value", "\n").alias("record")))


def _fields(record: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f',("{_QUOTED}"[^,]*+|{_OPEN}|[^,]*+)'), F.lit(1))


def _value(cell: Column) -> Column:
    quoted = f'(?s)^"({_QUOTED})"?(.*)$'
    return F.when(cell.startswith('"'), F.concat(F.replace(F.regexp_extract(cell, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(cell, quoted, 2))).otherwise(cell)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``file_no`` (the file's path), ``row_idx``, ``col_idx``, ``value`` of every cell that is not missing; see ``records``."""
    cells = records(spark, path).select("file_no", F.col("row_idx").cast("int").alias("row_idx"), F.posexplode(_fields(F.col("record"))).alias("col_idx", "value"))
    return cells.withColumn("value", _value(F.col("value"))).where(~F.col("value").isin(MISSING))


def read_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``file_no``, ``row_idx`` and the first cells of every record by the given names, null where missing: what ``read_cells`` gives, without bringing the cells of a row together again."""
    rows = records(spark, path).select("file_no", F.col("row_idx").cast("int").alias("row_idx"), _fields(F.col("record")).alias("cells"))
    rows = rows.select("file_no", "row_idx", *[_value(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    return rows.select("file_no", "row_idx", *[F.when(~F.col(n).isin(MISSING), F.col(n)).alias(n) for n in names])
