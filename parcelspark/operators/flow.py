"""Spreadsheet cells to stored records, end to end: headers, mapping, values, addresses, rates, coordinates, duplicates, and the two schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_header, parsed, to_float_2
from ..sources.scratch import kept
from . import ingest, mapping, rates, store
from .duplicates import exact, without_duplicates
from .ingest import FILE
from .matching import cosine


# Cleaned headers that name the unit of a lease's rate.
RATE_HEADERS = ["rate psf", "rent", "base rent", "base rent yearly", "base rent monthly", "rental rate"]


def rate_headers(heads: DataFrame, data: DataFrame, found: DataFrame) -> DataFrame:
    """``file_no, rate_header``: the first column whose header is one of ``RATE_HEADERS``; without one, the column that is mapped to the rate if its cells are
    plain numbers with decimals or gaps, of two decimals at most (what a reader takes for numbers and cleaning leaves as they are). Other files have no row, and their rates decide."""
    named = heads.where(F.col("header").isin(RATE_HEADERS)).groupBy(FILE).agg(F.min_by("shown", "col_idx").alias("named"))
    cells = data.join(found.where("field = 'rate_psf'").select(FILE, "col_idx"), [FILE, "col_idx"])
    x = parsed(F.col("value"))
    plain = cells.groupBy(FILE, "col_idx").agg(F.bool_and(x.isNotNull() & (x == F.round(x, 2))).alias("plain"), F.bool_or(F.col("value").rlike("[.eE]")).alias("real"), F.count("*").alias("n"))
    rows = data.groupBy(FILE).agg(F.count_distinct("row_idx").alias("rows"))
    plain = plain.join(rows, FILE).where(F.col("plain") & (F.col("real") | (F.col("n") < F.col("rows")))).join(heads.select(FILE, "col_idx", "shown"), [FILE, "col_idx"])
    both = named.join(plain.select(FILE, F.col("shown").alias("mapped")), FILE, "full")
    return both.select(FILE, F.coalesce("named", "mapped").alias("rate_header"))


def ingested(cells: DataFrame, gazetteer: DataFrame, stored: DataFrame | None = None, address_names: tuple[str, ...] = ("address", "location", "street", "property"),
             fuzzy: bool = True, vectors: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``SALE`` and ``LEASE`` rows in their stored schemas, of files of those kinds; files of both or no kind are left out.

    A file's kind comes from its headers and its name. Columns are mapped by aliases, close spellings too unless ``fuzzy`` is off, and, with ``vectors`` (header, header_vector; field, field_vector), by
    the likeness of their names; the assignment of a file is the one of greatest total. Up to three address-like columns (by vectors, else by name) are joined to ``raw_address_data``, or the mapped address where there is none; the
    better of the two is geocoded against ``gazetteer`` (address, latitude, longitude, city, zip_code). The unit of a lease's rate comes from ``rate_headers``, else
    from the level of the file's rates. Rows whose address is in ``stored`` (id, address), or earlier in the batch, are not returned. Ids are a hash of the file
    and the row number, which spreadsheets keep below 2 ** 20, so of equal addresses in a file the first stays.
    """
    names = kept(ingest.headers(cells), "ingest-headers")
    kinds = ingest.file_classes(names, F.substring_index(F.col(FILE).cast("string"), "/", -1)).select(FILE, "kind")
    data = ingest.data_cells(cells, names)
    heads = names.withColumnRenamed("header", "shown").withColumn("header", clean_header(F.col("shown"))).join(kinds, FILE)
    heads = heads.withColumn("header", F.when(F.col("header") == "", "unknown column").otherwise(F.col("header")))
    heads = kept(heads.join(ingest.profiles(data), [FILE, "col_idx"], "left").withColumn("profile", F.coalesce("profile", F.lit("empty"))), "ingest-heads")
    found = kept(mapping.exact_assignment(mapping.pair_scores(heads, mapping.alias_levels(heads, fuzzy=fuzzy), *(vectors or ()))), "ingest-mapping")
    fields = {**mapping.LEASE_FIELDS, **mapping.SALE_FIELDS}
    wide = mapping.standardized(data, found, list(fields))
    if vectors is None:
        # a header that names the address takes part in the joined address, the more so the more of it the name makes up
        alike = F.greatest(*[F.when(F.col("header").contains(n), 0.6 + 0.4 * F.lit(float(len(n))) / F.length("header")).otherwise(0.0) for n in address_names])
        near = mapping.address_candidates(heads, alike)
    else:
        target = vectors[1].where("field = 'address'").select(F.col("field_vector").alias("target"))  # one row
        near = mapping.address_candidates(heads.join(vectors[0], "header").crossJoin(F.broadcast(target)), cosine(F.col("header_vector"), F.col("target")))
    joined = mapping.joined_addresses(data, near)
    rate = rate_headers(heads, data, found)
    rows = wide.join(joined, [FILE, "row_idx"], "left").join(rate, FILE, "left").join(kinds, FILE).where(F.col("kind").isin("SALE", "LEASE"))
    rows = rows.withColumns({n: to_float_2(F.col(n)) for n, t in fields.items() if t.startswith("numeric")})
    rows = rows.withColumn("raw_address_data", F.coalesce("raw_address_data", "address")).withColumn("address", F.coalesce("address", "raw_address_data")).where("address is not null")
    rows = rates.with_rates(rows, FILE).withColumn("price_per_sf", rates.fill_price_per_sf(F.col("sale_price"), F.col("building_size"), F.col("price_per_sf")))
    rows = kept(rows.withColumn("id", F.shiftleft(F.xxhash64(FILE).bitwiseAND(F.lit((1 << 43) - 1)), 20) + F.col("row_idx")).withColumn("source_file", F.col(FILE).cast("string")), "ingest-rows")
    placed = store.geocoded(rows.select("id", "address"), gazetteer).select("id", F.col("address").alias("found_address"), "latitude", "longitude", "city", "zip_code")
    rows = rows.join(placed, "id").withColumn("address", F.col("found_address"))
    new = rows.select(F.col("id").alias("new_id"), "address", "kind")
    out = {}
    for kind, schema in (("SALE", store.SALE), ("LEASE", store.LEASE)):
        mine = new.where(F.col("kind") == kind).drop("kind")
        none = mine.select(F.col("new_id").alias("id"), "address").where("false")
        fresh = without_duplicates(mine, exact(mine, none if stored is None else stored), within_batch=True)
        out[kind] = store.conformed(rows.join(fresh.select(F.col("new_id").alias("id")), "id", "left_semi"), schema)
    return out
