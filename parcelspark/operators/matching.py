"""Comparable scoring and ranking for one or many subjects.

Each similarity dimension is a Column of the joined pair; subjects are the small side of the join. Null modes: ``skip`` leaves a
dimension out where either side is missing; ``compat`` scores a missing numeric value 0 (1 where the subject's value is 0), provided
that some record has the column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import age_years
from ..functions.geo import EARTH_MILES, haversine
from ..sources.scratch import kept, short_methods, spread

# Default weights, tolerances and limits.
WEIGHTS = {"proximity": 0.30, "size": 0.25, "price": 0.20, "price_psf": 0.10, "year_built": 0.10, "recency": 0.15}
LEASE_WEIGHTS = {"proximity": 0.30, "size": 0.25, "rate_monthly": 0.20, "rate_annually": 0.10, "building_type": 0.10, "recency": 0.15}
TOLERANCE, YEAR_TOLERANCE, RADIUS, YEARS, TOP = 0.5, 0.15, 25.0, 3.0, 20
#: A subject side of at most so many rows and bytes is broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Beside so many queries records are read as they lie, without a shuffle.
FEW = 16


def proximity(distance: Column, radius: float = RADIUS) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / radius), F.lit(0.0))


def numeric(subject: Column, comp: Column, tolerance: float = TOLERANCE, compat_has_column: Column | None = None) -> Column:
    """1 at equality, falling to 0 at ``tolerance`` relative difference."""
    most = F.greatest(F.abs(subject), F.abs(comp))
    score = F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(subject - comp), most) / tolerance))
    score = F.when(subject.isNotNull() & comp.isNotNull(), score)
    if compat_has_column is None:
        return score
    return F.when(subject.isNotNull() & comp.isNull() & compat_has_column, F.when(subject == 0, 1.0).otherwise(0.0)).otherwise(score)


def category(subject: Column, comp: Column) -> Column:
    return F.when(subject.isNull() | comp.isNull(), None).when(F.lower(F.trim(subject)) == F.lower(F.trim(comp)), 1.0).otherwise(0.0)


def recency(date: Column, as_of: Column, years: float = YEARS) -> Column:
    age = age_years(date, as_of)
    return F.when(date.isNull(), None).when(date > as_of, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - age / years))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times score over sum of weights, over the dimensions with a positive weight and a score; 0 if none."""
    on = [(scores[k], w) for k, w in weights.items() if w > 0 and k in scores]
    top = sum((F.when(s.isNotNull(), w * s).otherwise(0.0) for s, w in on), F.lit(0.0))
    return F.coalesce(F.try_divide(top, sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in on), F.lit(0.0))), F.lit(0.0))


Dimensions = dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]]


def sale_dimensions(as_of: Column, compat: bool = False) -> Dimensions:
    """Dimension name to a function of (subject's column, record's column); callers may add their own."""
    def num(field: str, tolerance: float = TOLERANCE):
        return lambda s, c: numeric(s(field), c(field), tolerance, c(f"has_{field}") if compat else None)

    return {"proximity": lambda s, c: proximity(c("distance_miles")), "size": num("building_size"), "price": num("sale_price"), "price_psf": num("price_per_sf"),
            "year_built": num("year_built", YEAR_TOLERANCE), "recency": lambda s, c: recency(c("closing_date"), as_of)}


def lease_dimensions(as_of: Column) -> Dimensions:
    def num(field: str):
        return lambda s, c: numeric(s(field), c(field))

    return {"proximity": lambda s, c: proximity(c("distance_miles")), "size": num("leased_sf"), "rate_monthly": num("rate_monthly"), "rate_annually": num("rate_annually"),
            "building_type": lambda s, c: category(s("building_type"), c("building_type")), "recency": lambda s, c: recency(c("commencement_date"), as_of)}


def _pair_scores(pairs: DataFrame, comps: DataFrame, subjects: DataFrame, dimensions: Dimensions, weights: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of rows that hold a record and, with ``s_`` before its columns' names, a subject."""
    absent = [n for n in ("building_size", "sale_price", "price_per_sf", "year_built", "leased_sf", "rate_monthly", "rate_annually", "building_type") if n in comps.columns and n not in subjects.columns]
    pairs = pairs.withColumns({f"s_{n}": F.lit(None).cast(dict(comps.dtypes)[n]) for n in absent}) if absent else pairs
    pairs = pairs.withColumn("distance_miles", haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")))
    subject, comp = lambda f: F.col(f"s_{f}"), F.col
    found = {n: d(subject, comp) for n, d in dimensions.items()}
    pairs = pairs.select("subject_id", "id", *keep, F.round("distance_miles", 1).alias("distance_miles"), *[c.alias(f"{n}_score") for n, c in found.items()])
    return pairs.withColumn("match_score", weighted({n: F.col(f"{n}_score") for n in found}, weights))


def _named(subjects: DataFrame) -> DataFrame:
    return subjects.withColumnsRenamed({c: f"s_{c}" for c in subjects.columns if c != "subject_id"})


def scored(comps: DataFrame, subjects: DataFrame, dimensions: Dimensions, weights: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """``subject_id, id``, the columns to keep, one ``<dimension>_score`` each, ``distance_miles`` and ``match_score``, for every pair.

    The subjects are a stated query set held against all records; they are broadcast block by block.
    """
    return _pair_scores(in_blocks(comps, _named(subjects), "subject_id"), comps, subjects, dimensions, weights, keep)


@dataclass
class Bound:
    """The most that a dimension can score in a cell, from the subject's column and the least and greatest value of a field in the cell; ``always``: it has a score even where the field is null."""

    field: str
    most: Callable[[Callable[[str], Column], Callable[[str], Column], Callable[[str], Column]], Column]
    always: bool = False


def _nearest(s: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(s, low), high)


def _least_distance(s, low, high) -> Column:
    """No point of the cell is closer: each term of the haversine at its least."""
    away = lambda f: F.radians(F.greatest(F.lit(0.0), low(f) - s(f), s(f) - high(f)))
    wraps = F.greatest(F.abs(s("longitude") - low("longitude")), F.abs(s("longitude") - high("longitude"))) > 180
    a = F.pow(F.sin(away("latitude") / 2), 2) + F.when(wraps, 0.0).otherwise(
        F.cos(F.radians(s("latitude"))) * F.least(F.cos(F.radians(low("latitude"))), F.cos(F.radians(high("latitude")))) * F.pow(F.sin(away("longitude") / 2), 2))
    return EARTH_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def _number_bound(field: str, tolerance: float = TOLERANCE) -> Bound:
    return Bound(field, lambda s, low, high: numeric(s(field), _nearest(s(field), low(field), high(field)), tolerance))


def sale_bounds(as_of: Column) -> dict[str, Bound]:
    """Bounds of ``sale_dimensions``. Tolerances are at most 1, so a number's score falls on both sides of the subject's."""
    return {"proximity": Bound("latitude", lambda s, low, high: proximity(_least_distance(s, low, high)), always=True), "size": _number_bound("building_size"), "price": _number_bound("sale_price"),
            "price_psf": _number_bound("price_per_sf"), "year_built": _number_bound("year_built", YEAR_TOLERANCE), "recency": Bound("closing_date", lambda s, low, high: recency(high("closing_date"), as_of))}


def sale_cells(miles: float = 4.0, ratio: float = 1.4) -> list[list[Column]]:
    """Columns that make up cells, each level within the one before: squares of four times ``miles`` and of ``miles``, sizes and then prices in steps of ``ratio``, and what is missing."""
    square = lambda miles: [F.floor(F.col(c) / (miles / 69.0)) for c in ("latitude", "longitude")]
    step = lambda c: F.floor(F.ln(c) / F.ln(F.lit(ratio)))
    return [square(4 * miles), square(miles), [step("building_size")], [step("sale_price")], [F.isnull(c) for c in ("building_size", "sale_price", "price_per_sf", "year_built", "closing_date")]]


def _most(cells: DataFrame, subjects: list[str], bounds: dict[str, Bound], weights: dict[str, float]) -> DataFrame:
    """``cells`` with ``most``, the best weighted score that a row of the cell can have.

    Where some of the cell's rows lack a field, a row may have its dimension or not, so the best is the greatest mean over the fixed dimensions and any of those: it takes in each one that lies above the mean itself,
    which repeated means find after a few steps.
    """
    subject = lambda f: F.col(f"s_{f}") if f in subjects else F.lit(None).cast("double")
    used = [(weights[n], b) for n, b in bounds.items() if weights.get(n, 0.0) > 0]
    best = {f"best_{i}": b.most(subject, lambda f: F.col(f"low_{f}"), lambda f: F.col(f"high_{f}")) for i, (_, b) in enumerate(used)}
    fixed = {f"fixed_{i}": F.lit(b.always) | (F.col(f"n_{b.field}") == F.col("n")) for i, (_, b) in enumerate(used)}

    def mean(least: Column) -> Column:
        taken = [F.col(f"best_{i}").isNotNull() & (F.col(f"fixed_{i}") | (F.col(f"best_{i}") > least)) for i in range(len(used))]
        top = sum((F.when(t, w * F.col(f"best_{i}")).otherwise(0.0) for i, (t, (w, _)) in enumerate(zip(taken, used))), F.lit(0.0))
        return F.coalesce(F.try_divide(top, sum((F.when(t, w).otherwise(0.0) for t, (w, _) in zip(taken, used)), F.lit(0.0))), least)

    # a projection for each step, so that it is compiled; the row number keeps filters on the result from being written out below them
    cells = cells.withColumns(best | fixed).withColumn("most", F.lit(0.0))
    for _ in range(len(used) + 1):
        cells = cells.withColumn("most", mean(F.col("most")))
    return cells.withColumn("nth", F.monotonically_increasing_id()).where("nth >= 0").drop("nth", *best, *fixed)


def _ranges(rows: DataFrame, key: str, fields: list[str], *above: str) -> DataFrame:
    whole = "n" not in rows.columns
    low, high, n = (lambda f: F.col(f)), (lambda f: F.col(f)), F.count("*")
    if not whole:
        low, high, n = (lambda f: F.col(f"low_{f}")), (lambda f: F.col(f"high_{f}")), F.sum("n")
    known = lambda f: F.count(f) if whole else F.sum(f"n_{f}")
    return rows.groupBy(key, *above).agg(n.alias("n"), *[c for f in fields for c in (F.min(low(f)).alias(f"low_{f}"), F.max(high(f)).alias(f"high_{f}"), known(f).alias(f"n_{f}"))])


def top_matches(comps: DataFrame, subjects: DataFrame, dimensions: Dimensions, bounds: dict[str, Bound], weights: dict[str, float], cells: list[list[Column]], k: int = TOP,
                digits: int = 6, first: int = 8, counted: list[int] | None = None) -> DataFrame:
    """``subject_id, rank, id, match_score``: the k best records of each subject by the score rounded to ``digits``, as ``ranked`` over ``scored``, from a part of the pairs.

    Records are put into cells, level within level, which keep the range of each field. A cell's bound is the best score any row in it can have. Each subject first goes down the cells with the
    highest bounds, fewer at every level, until the narrowest hold ``first`` times k rows; its k-th score there is a floor. Then it goes down the cells whose bound reaches the floor, a level at a time;
    no other can hold one of its k best. Every dimension with a weight needs a bound. Cells are joined with rows by their key, so a crowded
    cell is split like any skewed key. Runs jobs: the records with their cells, the ranges and the floors are written. ``counted`` gets the number of pairs scored.
    """
    if missing := {n for n in dimensions if weights.get(n, 0) > 0} - set(bounds):
        raise ValueError(f"no bounds for {sorted(missing)}")
    fields = sorted({b.field for b in bounds.values()} | {"latitude", "longitude"})
    keys = [*[f"level{i}" for i in range(len(cells) - 1)], "narrow"]
    rows = comps
    for i, own in enumerate(cells):
        rows = rows.withColumn(keys[i], F.xxhash64(*keys[:i][-1:], *own))
    rows = kept(spread(rows.select(*keys, "id", *fields), "narrow"), "match-rows")
    tables = [rows]
    for i in reversed(range(len(keys))):
        tables.insert(0, kept(spread(_ranges(tables[0], keys[i], fields, *keys[:i]), keys[i]), f"{keys[i]}-cells"))
    asked = kept(_named(subjects), "subjects")
    names = subjects.columns
    with short_methods(comps.sparkSession):
        top = _most(in_blocks(tables[0], asked, "subject_id"), names, bounds, weights)
        top = kept(top.select("subject_id", keys[0], "n", "most"), "top-bounds")
    small = _parts(asked) == 1
    asked = F.broadcast(asked) if small else asked

    def below(some: DataFrame, i: int) -> DataFrame:
        """The cells of a level within some of the level above, with their bounds."""
        pairs = spread(some.select("subject_id", keys[i - 1], *(["floor"] if "floor" in some.columns else [])), "subject_id", keys[i - 1]).join(tables[i].drop(*keys[: i - 1]), keys[i - 1]).join(asked, "subject_id")
        return _most(pairs, names, bounds, weights)

    def reached(floor: DataFrame) -> DataFrame:
        found = top.join(floor, "subject_id", "left")
        for i in range(1, len(keys)):
            found = below(_reached(found, digits), i)
        return found

    def scores(some: DataFrame) -> DataFrame:
        pairs = spread(some.select("subject_id", "narrow"), "subject_id", "narrow").join(rows.drop(*keys[:-1]), "narrow").join(asked, "subject_id")
        return _pair_scores(pairs, comps, subjects, dimensions, weights).select("subject_id", "id", F.round("match_score", digits).alias("match_score"))

    start = top
    for i, key in enumerate(keys):
        start = _first(start if i == 0 else below(start, i), key, first * k * 8 ** (len(keys) - 1 - i))
    with short_methods(comps.sparkSession):
        return _by_bounds(start, reached, scores, k, digits, counted)


def _first(cells: DataFrame, key: str, rows: int) -> DataFrame:
    """Each subject's cells with the highest bounds, until they hold so many rows."""
    before = F.sum("n").over(W.partitionBy("subject_id").orderBy(F.col("most").desc(), key).rowsBetween(W.unboundedPreceding, -1))
    return cells.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < rows).drop("before")


def _reached(cells: DataFrame, digits: int) -> DataFrame:
    """Cells whose bound reaches the subject's floor, as far as rounding goes."""
    return cells.where((F.col("most") > 0) & (F.col("most") >= F.coalesce("floor", F.lit(0.0)) - 10.0**-digits))


def _by_bounds(start: DataFrame, cells: Callable[[DataFrame], DataFrame], scores: Callable[[DataFrame], DataFrame], k: int, digits: int, counted: list[int] | None) -> DataFrame:
    """The k best of each subject: read the cells of ``start``, take the k-th score as a floor, and read those of ``cells(floor)`` whose bound reaches it."""
    start = kept(start.select("subject_id", "narrow", "n"), "first-cells")
    found = kept(scores(start), "first-scores")
    floor = ranked(found, k).where(F.col("rank") == k).select("subject_id", F.col("match_score").alias("floor"))
    more = kept(_reached(cells(floor), digits).select("subject_id", "narrow", "n").join(start, ["subject_id", "narrow"], "left_anti"), "more-cells")
    if counted is not None:
        counted.append(start.unionByName(more).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rest = kept(ranked(scores(more), k).drop("rank"), "more-scores")
    return ranked(found.unionByName(rest), k).select("subject_id", "rank", "id", "match_score")


def _parts(df: DataFrame) -> int:
    """Into how many parts a table must be dealt so that each may be broadcast: by rows, and by bytes as written out in text, which is more than they take in memory. A job."""
    return _counted(df)[0]


def _counted(df: DataFrame) -> tuple[int, int]:
    """``_parts``, and the number of rows."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return max(found["n"] // BROADCAST_ROWS, found["bytes"] // BROADCAST_BYTES) + 1, found["n"]


def in_blocks(records: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """All records beside each of a stated query set. Queries are dealt by hash into blocks of about ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` at most, and every block is broadcast. For more than ``FEW`` queries the records are spread first."""
    n, rows = _counted(queries)
    records = spread(records) if rows > FEW else records
    block = F.pmod(F.xxhash64(key), F.lit(n))
    out = None
    for k in range(n):
        part = records.crossJoin(F.broadcast(queries.where(block == k) if n > 1 else queries))
        out = part if out is None else out.unionByName(part)
    return out


def blended(weighted_score: Column, similarity: Column, alpha: float = 0.3) -> Column:
    return F.when(similarity.isNull(), weighted_score).otherwise((1 - alpha) * weighted_score + alpha * similarity)


def ranked(pairs: DataFrame, k: int = TOP, score: str = "match_score") -> DataFrame:
    """The k best of each subject with a positive score; ids break ties. Spark keeps at most k rows of each subject per task before the shuffle.

    Scores are filtered after the ranks, where the rest comes last: a filter below them would go down to the joins and work every score out there once more, written out, which is too long to compile.
    """
    w = W.partitionBy("subject_id").orderBy(F.col(score).desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col(score) > 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """max(0, cosine similarity) of two vectors; 0 if either has no length."""
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))), F.lit(0.0))


#: Pivots at most, and the width of the rings around them in radians.
PIVOTS, RING = 256, 0.1
#: Vectors that a task holds at a time, about, and the pairs that are worked out together, at most.
TILE, TOGETHER = 32_768, 1 << 20


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _tile_best(k: int, digits: int):
    """Of rows sorted by ring, part and kind, the k vectors of each part (kind 0) with the greatest positive rounded dot product with each query (kind 1) but that of its own id, ties by id."""
    def best(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, asked: np.ndarray, kinds: list[pa.DataType]) -> pa.RecordBatch:
        found = []
        step = max(1, TOGETHER // len(ids))
        for low in range(0, len(own), step):
            some = slice(low, low + step)
            score = asked[some] @ vectors.T
            score[own[some, None] == ids] = 0.0
            place = np.floor(score * 10.0**digits + 0.5)
            least = np.partition(place, -k, axis=1)[:, -k] if k < len(ids) else np.zeros(len(score))
            row, col = np.nonzero((place >= least[:, None]) & (place > 0))
            order = np.lexsort((col, -place[row, col], row))  # columns are in the order of ids
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((own[some][row[first]], ids[col[first]], score[row[first], col[first]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), kinds)], names=["subject_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, tile = None, [], None
        for batch in batches:
            narrow, part, kind = (batch.column(c).to_numpy() for c in ("narrow", "part", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(narrow) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(kind)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                if of != (of := (narrow[low], part[low])):
                    held, tile = [], None
                if kind[low] == 0:
                    held.append(rows)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    ids, vectors = whole.column("id").to_numpy(), _matrix(whole.column("vector").chunk(0))
                    order = np.argsort(ids, kind="stable")
                    held, tile = [], (ids[order], vectors[order])
                if tile is not None:
                    same = np.flatnonzero(rows.column("vector").value_lengths().to_numpy() == tile[1].shape[1])
                    if len(same):
                        rows = rows.take(pa.array(same))
                        yield best(*tile, rows.column("subject_id").to_numpy(zero_copy_only=False), _matrix(rows.column("vector")), [rows.schema.field("subject_id").type, rows.schema.field("id").type, pa.float64()])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, digits: int = 5, first: int = 8, counted: list[int] | None = None) -> DataFrame:
    """``subject_id, rank, id, similarity``: the k vectors (``id, vector``) with the greatest cosine to each query (``subject_id, query``) but the one of its own id; ties by id; similarities of 0 and below are left out.

    Every vector is brought to length 1 once. A few vectors, the least by a hash of their ids, are pivots: at most ``PIVOTS``, so they and the cells around them are broadcast. A vector belongs to the ring around its
    nearest pivot that holds its angle to it. An angle is at least the difference of two angles to a third vector, so a ring bounds the cosine of all in it, and a query reads only the rings that reach its k-th best so far. Clustered
    vectors leave most rings unread; vectors without any structure in many dimensions leave few. A ring is read in parts of about ``TILE`` vectors: the queries that want it stream past each part, which gives the k best of each query, so no row is made for
    a pair. Vectors of different numbers of components, with nulls or without a finite length take no part. Runs jobs. ``counted`` gets the dot products, those with pivots too.
    """
    def unit(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("length", F.sqrt(dot(F.col(name), F.col(name)))).where("length > 0 and length < double('infinity')")
        return df.withColumn(name, F.transform(name, lambda x: x / F.col("length"))).drop("length")

    rows = kept(unit(spread(vectors.select("id", "vector")), "vector"), "unit-vectors")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, round(n**0.5 / 4))))
    pivots = some.agg(F.collect_list("vector").alias("pivots"))  # one row of at most PIVOTS vectors

    def angles(df: DataFrame, name: str) -> DataFrame:
        near = F.transform("pivots", lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, F.col(name))))))
        return df.crossJoin(F.broadcast(pivots)).withColumn("angles", near).drop("pivots")

    placed = angles(spread(rows), "vector").withColumn("angle", F.array_min("angles")).withColumn("pivot", F.array_position("angles", F.col("angle")).cast("int"))
    placed = kept(placed.withColumn("narrow", F.when(F.col("angle").isNotNull(), F.xxhash64("pivot", F.floor(F.col("angle") / RING)))).drop("angles"), "ring-vectors")
    rings = placed.groupBy("narrow").agg(F.first("pivot").alias("pivot"), F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    asked = kept(angles(unit(spread(queries.select("subject_id", "query")), "query"), "query"), "unit-queries")
    at, slack = F.element_at("angles", F.col("pivot")), 1e-6
    pairs = spread(asked.drop("query")).crossJoin(F.broadcast(rings))  # at most 33 rings a pivot
    most = F.cos(F.greatest(F.lit(0.0), F.col("low") - at - slack, at - F.col("high") - slack))
    bounds = kept(pairs.select("subject_id", "narrow", "n", most.alias("most")), "ring-bounds")
    if counted is not None:
        counted.append((n + asked.count()) * pivots.select(F.size("pivots")).first()[0])
    parts = F.ceil(F.col("n") / TILE).cast("int")  # of a ring
    held = placed.where("id is not null").join(F.broadcast(rings.select("narrow", "n")), "narrow").select("narrow", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "id", F.lit(None).cast(asked.schema["subject_id"].dataType).alias("subject_id"), "vector")
    kinds = {c: t for df in (asked, placed) for c, t in df.dtypes}

    def scores(cells: DataFrame) -> DataFrame:
        wanted = cells.join(asked.where("subject_id is not null"), "subject_id").select("narrow", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(placed.schema["id"].dataType).alias("id"), "subject_id", F.col("query").alias("vector"))
        tiles = spread(held.unionByName(wanted), "narrow", "part").sortWithinPartitions("narrow", "part", "kind")
        best = tiles.mapInArrow(_tile_best(k, digits), f"subject_id {kinds['subject_id']}, id {kinds['id']}, score double")
        return best.select("subject_id", "id", F.round("score", digits).alias("match_score"))

    found = _by_bounds(_first(bounds, "narrow", first * k), lambda floor: bounds.join(floor, "subject_id", "left"), scores, k, digits, counted)
    return found.withColumnRenamed("match_score", "similarity")


def description(c: Callable[[str], Column] = F.col) -> Column:
    """One line about a sale, leaving out what is missing."""
    part = lambda field, text: F.when(c(field).isNotNull(), text)
    whole = lambda field: F.format_number(c(field), 0)
    return F.concat_ws(", ", F.coalesce(c("address"), F.lit("Unknown location")), part("building_size", F.concat(whole("building_size"), F.lit(" SF"))), part("sale_price", F.concat(F.lit("$"), whole("sale_price"))),
                       part("price_per_sf", F.concat(F.lit("$"), F.format_number(c("price_per_sf"), 2), F.lit("/SF"))), part("year_built", F.concat(F.lit("built "), c("year_built").cast("int"))),
                       part("cap_rate", F.concat(F.format_number(c("cap_rate"), 1), F.lit("% cap rate"))), part("closing_date", F.concat(F.lit("closed "), c("closing_date"))), c("city"), c("notes"))
