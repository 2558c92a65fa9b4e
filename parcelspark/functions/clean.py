"""Scalar cleaning functions: Column to Column, all built from native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in the order in which they are applied, placeholders, and the states' spellings that are looked for.
ABBREVIATIONS = [("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("parkway", "pkwy"), ("highway", "hwy"),
                 ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"), ("suite", "ste"), ("building", "bldg"), ("floor", "fl")]
PLACEHOLDERS = ["", "-", "_", "--", "N/A", "n/a", "nan", "None", "TBD", "tbd"]
STATE_MARKS = [" tx", " texas", ", tx", ",tx"]
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
DATE_FORMATS = [(r"^\d{4}-\d{2}-\d{2}( .*)?$", "yyyy-MM-dd", 10), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", 0), (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy", 0),
                (r"^[A-Za-z]{3}-\d{2}$", "MMM-yy", 0), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", 0)]
#: White space as a spreadsheet holds it, no-break spaces included.
BLANK = "[\\s\u00a0]+"
#: Every character that counts as white space in text: Unicode's, and the separators 1C to 1F.
SPACES = r"[\p{IsWhite_Space}\x1c-\x1f]"


def stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), BLANK, " "))


def parsed(c: Column) -> Column:
    """A plain decimal number as a double; anything else (infinities too) is null."""
    c = F.trim(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def clean_header(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"[\n\r\t]+", " ")
    c = F.regexp_replace(F.translate(c, "_.", "  "), r"(?U)[^\w\s/]", "")
    return F.regexp_replace(F.trim(c), r"(?U)\s+", " ")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once; written out, a value that is used often makes code that is too long to compile."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def to_float(c: Column) -> Column:
    """The number in a spreadsheet cell: percent and per-unit forms, currency, or the first run of digits if it is no noise."""
    def number(s: Column) -> Column:
        percent = F.nullif(F.regexp_extract(s, r"^([\d.]+)\s*%", 1), F.lit(""))
        per_unit = F.nullif(F.regexp_extract(s, r"^([\d.]+)\s*/\s*\w+", 1), F.lit(""))
        pieces = r"(?s)^([^0-9]*)([0-9]+\.?[0-9]*)(.*)$"
        rest = F.length(F.trim(F.concat(F.regexp_extract(s, pieces, 1), F.regexp_extract(s, pieces, 3))))
        some = bound(F.regexp_extract(s, pieces, 2), lambda run: F.when((run != "") & ((F.length(run) >= 2) | (rest <= 2 * F.length(run))), parsed(run)))
        return F.when(percent.isNotNull(), parsed(percent)).otherwise(F.coalesce(parsed(per_unit), parsed(s), some))

    return bound(stripped(c), lambda text: F.when(~text.isin(PLACEHOLDERS), bound(F.regexp_replace(text, r"sf|SF|[,$]", ""), number)))


def to_float_2(c: Column) -> Column:
    return F.round(to_float(c), 2)


def currency(c: Column) -> Column:
    """The strict form: after dropping marks the whole must be a number."""
    text = F.regexp_replace(F.lower(stripped(c)), r"sf|[,$%]", "")
    return F.round(parsed(text), 2)


def text_value(c: Column, compat: bool = False) -> Column:
    """Trimmed text, blank to null; ``compat`` tests for blank before trimming, so white space alone becomes ''."""
    return F.when(c != "", F.trim(c)) if compat else F.nullif(F.trim(c), F.lit(""))


def normalize_address(c: Column) -> Column:
    """Lower case without punctuation, runs of any white space as one space, abbreviated. White space at the ends goes first, as punctuation beside it may not."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"^{SPACES}+|{SPACES}+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_" + SPACES[1:], ""), f"{SPACES}+", " ")
    short = F.create_map(*[F.lit(w) for pair in ABBREVIATIONS for w in pair])

    def abbreviated(c: Column) -> Column:
        # plain addresses take one pass over their words; others have word boundaries besides spaces
        by_word = F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
        by_pattern = reduce(lambda a, x: F.regexp_replace(a, rf"(?U)\b{x[0]}\b", x[1]), ABBREVIATIONS, c)
        return F.when(c.rlike("[^a-z0-9_ ]"), by_pattern).otherwise(by_word)

    return bound(c, abbreviated)


def extract_zip(c: Column, last: bool = False) -> Column:
    """The first (or last) stand-alone run of five digits."""
    return F.nullif(F.regexp_extract(c, r"(?s).*\b(\d{5})\b" if last else r"\b(\d{5})\b", 1), F.lit(""))


def extract_city(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i),\s*([A-Za-z\s]+?),\s*(?:TX|Texas)\b", 1)), F.lit(""))


def append_state(c: Column) -> Column:
    low = F.lower(c)
    return F.when(reduce(lambda a, m: a | low.contains(m), STATE_MARKS, F.lit(False)), c).otherwise(F.concat(c, F.lit(", TX")))


def simplify_address(c: Column) -> Column:
    """Without suite, unit, building and floor parts."""
    c = F.trim(F.regexp_replace(c, r"(?i)\b(suite|ste|unit|bldg|building|floor|fl)\s*[#]?\s*\w+", ""))
    return F.regexp_replace(c, r"\s+", " ")


def label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def truncated(c: Column, n: int) -> Column:
    return F.coalesce(F.substring(c.cast("string"), 1, n), F.lit("N/A"))


def parse_date(c: Column) -> Column:
    """The date in a text, by an explicit list of formats; 'May-25' is May 2025."""
    c = F.trim(c.cast("string"))
    tries = [F.when(c.rlike(rx), F.try_to_timestamp(F.substring(c, 1, n) if n else c, F.lit(fmt)).cast("date")) for rx, fmt, n in DATE_FORMATS]
    return F.coalesce(*tries)


def age_years(c: Column, as_of: Column) -> Column:
    return F.datediff(as_of, c) / F.lit(365.25)


def score_band(c: Column) -> Column:
    return F.when(c >= 0.7, "green").when(c >= 0.4, "orange").otherwise("lightred")


def confidence_status(c: Column) -> Column:
    return F.when(c >= 1.0, "Override").when(c >= 0.60, "High").when(c >= 0.45, "Medium").otherwise("Not Mapped")
