"""Columns to schema fields: aliases, semantic scores and one-to-one assignment per file.

Names in different files repeat, so aliases are matched once per distinct header. The alias and field tables are fixed and small; they are
expressions or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept, spread
from .ingest import FILE
from .matching import cosine

# Fields with their types, and the spellings of each field's column; those of leases and sales go before the common ones.
LEASE_FIELDS = {"address": "text", "tenant_name": "text", "leased_sf": "numeric_clean", "rate_psf": "numeric_money", "lease_type": "text", "term_months": "numeric_clean", "commencement_date": "date", "escalations": "text",
                "ti_allowance": "numeric_money", "free_rent": "text", "clear_height": "numeric_clean", "building_type": "text", "notes": "text"}
SALE_FIELDS = {"address": "text", "sale_price": "numeric_money", "building_size": "numeric_clean", "price_per_sf": "numeric_money", "closing_date": "date", "year_built": "numeric_clean", "cap_rate": "numeric_clean", "buyer": "text",
               "seller": "text", "notes": "text"}
COMMON = {
    "price_per_sf": ["price per sf", "sale price psf", "pps", "price psf", "per sf", "psf", "price/sf", "price sf", "price lsf"],
    "rate_psf": ["rent", "base rent", "rental rate", "base rent yearly", "base rent monthly", "base rate", "asking rate", "nnn rate", "gross rate", "rate", "rate month", "rate monthly", "rate per month", "rate/sf", "rate psf", "rate sf", "rate per sf",
                 "rate/acre", "rate acre", "rate / acre / month", "rate per acre"],
    "closing_date": ["date closed", "closing date", "sale date", "transaction date", "date of sale", "closed", "close date"],
    "escalations": ["esc", "escalation", "escalation percent", "steps", "annual increase", "bumps", "annual bumps"],
    "building_type": ["construction", "building class", "property type", "construction type", "class", "building type"],
    "term_months": ["months", "lease term", "term"], "notes": ["comments", "notes", "remarks"], "buyer": ["buyer", "purchaser"], "seller": ["seller", "grantor"],
    "cap_rate": ["cap rate", "in place cap rate", "goingin cap rate", "cap", "stabilized cap rate", "pricing guidance cap rate / yoc"],
    "sale_price": ["sale price", "purchase price", "total price", "consideration", "sale price $"],
    "building_size": ["rentable area", "size sf", "sizesf", "total sf", "building sf", "rba", "total sq ft", "sq ft", "area", "acreage", "acres", "land area"],
    "address": ["building name", "address", "property address", "property name", "property", "location", "street address"],
    "tenant_name": ["tenant", "tenant name", "lessee", "occupant", "company"],
    "commencement_date": ["commencement", "commencement date", "start date", "signed date", "lease commencement", "date"],
    "ti_allowance": ["ti", "ti allowance", "work letter", "tenant improvement"], "free_rent": ["free rent", "free rent months", "abatement", "concession"],
    "clear_height": ["clear height", "ceiling height", "clearance"], "year_built": ["year built", "built", "vintage"], "lease_type": ["lease type", "rate type", "structure", "lease structure"],
}
LEASE_ONLY = {"leased_sf": ["sf", "size", "sqft", "area leased", "leased sf", "space", "leased area", "deal sf"], "rate_psf": ["price"], "commencement_date": ["date"]}
SALE_ONLY = {"building_size": ["sf", "size", "sqft", "building size", "total size"], "sale_price": ["price"], "closing_date": ["date", "transaction date"]}
LOCK, THRESHOLD, FUZZY, ADDRESS_LEAST = 100.0, 0.55, 0.8, 0.55
NOT_ADDRESS = ["state", "city", "zip", "postal", "county", "country", "submarket"]


def fields(kind: str) -> dict[str, str]:
    return LEASE_FIELDS if kind == "LEASE" else SALE_FIELDS if kind == "SALE" else {**LEASE_FIELDS, **SALE_FIELDS}


def aliases(kind: str) -> list[tuple[str, str]]:
    """(alias, field); of an alias that has two fields, the kind's own holds. Files of both or no kind use the sale spellings."""
    out = {a: f for f, names in COMMON.items() for a in names}
    out.update({a: f for f, names in (LEASE_ONLY if kind == "LEASE" else SALE_ONLY).items() for a in names})
    return list(out.items())


def _alias_table(spark: SparkSession) -> DataFrame:
    rows = [(k, a, f, t) for k in ("LEASE", "SALE", "BOTH", "UNKNOWN") for a, f in aliases(k) for n, t in fields(k).items() if n == f]
    return spark.createDataFrame(rows, "kind string, alias string, field string, type string")


def _close(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    for header, alias in columns:
        yield pd.Series([SequenceMatcher(None, a, h).ratio() for h, a in zip(header, alias)], dtype="float64")


def alias_levels(heads: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``kind, header, field, level, alias_length`` for distinct (kind, cleaned header): 3 exact, 2 containing an alias of 3 letters or more, 1 close to one of 4 or more."""
    pairs = heads.select("kind", "header").distinct().join(F.broadcast(_alias_table(heads.sparkSession)), "kind")  # a fixed table of a few hundred rows
    inside = (F.length("alias") >= 3) & F.contains("header", "alias")
    level = F.when(F.col("header") == F.col("alias"), 3).when(inside, 2)
    if fuzzy:
        close = F.pandas_udf(_close, T.DoubleType())
        known = pairs.withColumn("level", level)
        near = known.where("level is null and length(alias) >= 4").where(F.levenshtein("header", "alias") <= (1 - FUZZY) * (F.length("header") + F.length("alias")) + 1e-9) \
            .where(close("header", "alias") >= FUZZY).withColumn("level", F.lit(1))
        pairs = known.where("level is not null").unionByName(near)
    else:
        pairs = pairs.withColumn("level", level).where("level is not null")
    best = pairs.groupBy("kind", "header", "field").agg(F.max(F.struct("level", F.length("alias").alias("n"))).alias("b"))
    return best.select("kind", "header", "field", F.col("b.level").alias("level"), F.col("b.n").alias("alias_length"))


def pair_scores(heads: DataFrame, levels: DataFrame, vectors: DataFrame | None = None, field_vectors: DataFrame | None = None) -> DataFrame:
    """``file_no, field, col_idx, score, level, alias_length`` of every file's columns and fields.

    ``heads``: file_no, col_idx, kind, header, profile. An alias of any level scores 100; else the score is the cosine of the header's and the field's vectors (0 without vectors) with a
    bonus or malus for the types.
    """
    rows = [(k, f, t) for k in ("LEASE", "SALE", "BOTH", "UNKNOWN") for f, t in fields(k).items()]
    table = heads.sparkSession.createDataFrame(rows, "kind string, field string, type string")
    pairs = heads.join(F.broadcast(table), "kind").join(levels, ["kind", "header", "field"], "left")  # fixed: at most 21 fields a column
    semantic = F.lit(0.0)
    if vectors is not None:
        pairs = pairs.join(vectors, "header", "left").join(F.broadcast(field_vectors), "field", "left")
        semantic = F.coalesce(cosine(F.col("header_vector"), F.col("field_vector")), F.lit(0.0))
    numeric = F.col("type").isin("numeric_money", "numeric_clean")
    bonus = F.when(F.col("type") == F.col("profile"), 0.25).when(numeric & (F.col("profile") == "text"), -0.20).when((F.col("type") == "date") & (F.col("profile") != "date"), -0.30) \
        .when((F.col("type") == "text") & F.col("profile").isin("numeric_money", "numeric_clean"), -0.15).otherwise(0.0)
    return pairs.select(FILE, "field", "col_idx", F.when(F.col("level").isNotNull(), F.lit(LOCK)).otherwise(semantic + bonus).alias("score"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("alias_length", F.lit(0)).alias("alias_length"))


def mutual_best(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One-to-one assignment by rounds of mutual best pairs until no pair is left; ties: higher level, longer alias, lower column, field name.

    Each round takes a pair of every file that has any left, so there are at most as many rounds as fields, 21.
    """
    left, out = kept(scores.where(F.col("score") >= threshold), "pair-scores"), None  # each round reads it several times
    order = [F.col("score").desc(), F.col("level").desc(), F.col("alias_length").desc(), F.col("col_idx"), F.col("field")]
    while out is None or not left.isEmpty():
        by_field = F.row_number().over(W.partitionBy(FILE, "field").orderBy(*order))
        by_col = F.row_number().over(W.partitionBy(FILE, "col_idx").orderBy(*order))
        best = left.withColumn("f", by_field).withColumn("c", by_col).where("f = 1 and c = 1").select(FILE, "field", "col_idx", "score")
        best = kept(best, "mutual-best")
        out = best if out is None else out.unionByName(best)
        left = kept(left.join(best.select(FILE, "field"), [FILE, "field"], "left_anti").join(best.select(FILE, "col_idx"), [FILE, "col_idx"], "left_anti"), "pair-scores")
    return out.select(FILE, "field", "col_idx", F.round(F.least("score", F.lit(1.0)), 3).alias("confidence"))


def assigned(gain: np.ndarray) -> list[int]:
    """For each row the column of an assignment of greatest sum, by shortest augmenting paths; -1 for rows left over."""
    rows, cols = gain.shape
    size = max(rows, cols)
    cost = np.zeros((size + 1, size + 1))
    cost[1: rows + 1, 1: cols + 1] = -gain
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j, least, seen, back = i, 0, np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while match[j]:
            seen[j] = True
            reduced = cost[match[j]] - u[match[j]] - v
            better = ~seen & (reduced < least)
            least[better], back[better] = reduced[better], j
            free = np.where(seen, np.inf, least)
            free[0] = np.inf
            k = int(free.argmin())
            step = free[k]
            u[match[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = k
        while j:
            match[j] = match[back[j]]
            j = back[j]
    out = [-1] * rows
    for j in range(1, size + 1):
        if match[j] <= rows and j <= cols:
            out[match[j] - 1] = j - 1
    return out


#: Different sets of scores whose assignments a task remembers.
MEMO = 10_000


def _solved(fields: np.ndarray, cols: np.ndarray, score: np.ndarray, gain: np.ndarray, threshold: float) -> list[tuple[str, int, float]]:
    """(field, col_idx, confidence) of the assignment of greatest total gain; pairs that are not there gain 0."""
    names, i = np.unique(fields.astype(str), return_inverse=True)
    places, j = np.unique(cols, return_inverse=True)
    grid, plain = np.zeros((len(names), len(places))), np.full((len(names), len(places)), -np.inf)
    grid[i, j], plain[i, j] = gain, score
    return [(str(names[f]), int(places[c]), round(min(float(plain[f, c]), 1.0), 3)) for f, c in enumerate(assigned(grid)) if c >= 0 and plain[f, c] >= threshold]


def exact_assignment(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The assignment of greatest total score per file; a file has at most 21 fields and its own columns, so a group is small. Files with the same scores have the same assignment, which a task works out once."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key = (tuple(r.field), r.col_idx.tobytes(), r.score.tobytes(), r.level.tobytes(), r.alias_length.tobytes())
                if (found := known.get(key)) is None:
                    if len(known) >= MEMO:
                        known.clear()
                    gain = r.score + r.level * 1e-3 + r.alias_length * 1e-6 - r.col_idx * 1e-9
                    found = known[key] = _solved(r.field, r.col_idx, r.score, gain, threshold)
                out += [(r[0], *x) for x in found]
            yield pd.DataFrame(out, columns=[FILE, "field", "col_idx", "confidence"])

    kind = dict(scores.dtypes)[FILE]
    names = ["field", "col_idx", "score", "level", "alias_length"]
    grids = spread(scores, FILE).groupBy(FILE).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("pairs"))
    return grids.select(FILE, *[F.col("pairs")[n].alias(n) for n in names]).mapInPandas(solve, f"{FILE} {kind}, field string, col_idx int, confidence double")


def address_candidates(heads: DataFrame, similarity, most: int = 3) -> DataFrame:
    """Up to three columns of a file whose header is near the address field and names no other part of an address."""
    rows = heads.withColumn("similarity", similarity).where(F.col("similarity") > ADDRESS_LEAST).where(~F.col("header").rlike("|".join(NOT_ADDRESS)))
    nth = F.row_number().over(W.partitionBy(FILE).orderBy(F.col("similarity").desc(), "col_idx"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select(FILE, "col_idx", "nth")


def joined_addresses(data: DataFrame, candidates: DataFrame) -> DataFrame:
    """``raw_address_data`` per row: the values of the candidate columns that are there, best column first, a column once."""
    once = candidates.groupBy(FILE, "col_idx").agg(F.min("nth").alias("nth"))
    parts = data.join(F.broadcast(once) if once.count() <= 100_000 else once, [FILE, "col_idx"]).groupBy(FILE, "row_idx") \
        .agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("parts"))  # three columns at most
    return parts.select(FILE, "row_idx", F.array_join("parts.value", " ").alias("raw_address_data"))


def standardized(data: DataFrame, mapping: DataFrame, names: list[str]) -> DataFrame:
    """Rows of canonical fields as text, keyed by file and row; the fields are fixed, so the pivot does not depend on the data."""
    return data.join(mapping.select(FILE, "col_idx", "field"), [FILE, "col_idx"]).groupBy(FILE, "row_idx").pivot("field", names).agg(F.max("value"))
