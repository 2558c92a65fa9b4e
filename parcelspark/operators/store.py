"""The property store as bucketed, versioned Parquet: load, append, update, delete, count; and geocoding against a gazetteer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import append_state, extract_city, extract_zip, normalize_address, simplify_address
from ..sources.scratch import kept
from .radius import bounds_checked

_TEXT, _NUM = T.StringType(), T.DoubleType()


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField("id", T.LongType(), False), *[T.StructField(n, t) for n, t in fields]])


# The two persisted schemas.
SALE = _schema([("address", _TEXT), ("latitude", _NUM), ("longitude", _NUM), ("sale_price", _NUM), ("building_size", _NUM), ("price_per_sf", _NUM), ("closing_date", _TEXT), ("year_built", _NUM), ("cap_rate", _NUM), ("buyer", _TEXT),
                ("seller", _TEXT), ("raw_address_data", _TEXT), ("notes", _TEXT), ("city", _TEXT), ("zip_code", _TEXT), ("source_file", _TEXT), ("source_file_url", _TEXT), ("created_at", T.TimestampType())])
LEASE = _schema([("address", _TEXT), ("latitude", _NUM), ("longitude", _NUM), ("tenant_name", _TEXT), ("leased_sf", _NUM), ("rate_monthly", _NUM), ("rate_annually", _NUM), ("lease_type", _TEXT), ("term_months", _NUM), ("commencement_date", _TEXT),
                 ("ti_allowance", _NUM), ("free_rent", _TEXT), ("escalations", _TEXT), ("building_type", _TEXT), ("clear_height", _NUM), ("raw_address_data", _TEXT), ("notes", _TEXT), ("city", _TEXT), ("zip_code", _TEXT), ("source_file", _TEXT),
                 ("source_file_url", _TEXT), ("created_at", T.TimestampType())])


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, cast; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema])


def loaded(df: DataFrame, numeric: list[str], round_all: bool = True, round_coords: bool = False) -> DataFrame:
    """Numbers that parse, rounded to 2 places; NaN becomes null. ``round_coords`` rounds coordinates as well."""
    out = {c: F.col(c).try_cast("double") for c in numeric}
    df = df.withColumns({c: F.when(~F.isnan(e), e) for c, e in out.items()})
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (round_coords or f.name not in ("latitude", "longitude"))]
    return df.withColumns({c: F.round(c, 2) for c in floats}) if round_all else df


def backfilled(df: DataFrame, rowwise: bool = False) -> DataFrame:
    """City and zip from the address: in every row that lacks them, or only if no row has any."""
    zip_, city = extract_zip(F.col("address")), extract_city(F.col("address"))
    if rowwise:
        return df.withColumn("zip_code", F.coalesce("zip_code", zip_)).withColumn("city", F.coalesce("city", city))
    known = df.agg((F.count("zip_code") == 0).alias("no_zip"), (F.count("city") == 0).alias("no_city"))  # one row
    df = df.crossJoin(F.broadcast(known))
    return df.withColumn("zip_code", F.when(F.col("no_zip"), zip_).otherwise(F.col("zip_code"))).withColumn("city", F.when(F.col("no_city"), city).otherwise(F.col("city"))).drop("no_zip", "no_city")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new, allowMissingColumns=True)


def updated(base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``base`` with the columns of their change; a null in a change is written. A row with several changes takes the latest by ``order``, ties and
    changes without an order by the greatest values."""
    one = changes.groupBy(key).agg(F.max(F.struct(*([order] if order else []), *columns)).alias("__new"))
    both = base.join(one, key, "left")
    return both.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def deleted(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


class Conflict(RuntimeError):
    """Another writer committed first; the change was not made and can be tried again."""


class Store:
    """A table as Parquet folders by hash bucket of the id, and numbered versions that name the folders and buckets that are live.

    A change reads and writes only the buckets that its ids fall into; an append writes only what is new. A version is a small file that is created only if its number is free, so readers see a change
    whole or not at all, and of two writers that start from the same version the second gets ``Conflict`` instead of undoing the first. Ids are whole numbers; ``buckets`` holds for the life of the store.
    """

    def __init__(self, spark, path: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _file(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> tuple[int, dict[str, list[int]]]:
        """The newest version's number, and its live buckets by folder; one that is still being written does not count."""
        fs, where = self._file(f"{self.path}/versions")
        names = sorted((f.getPath().getName() for f in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
        for name in names:
            row = self.spark.read.schema("live map<string,array<int>>").json(f"{self.path}/versions/{name}").first()
            if row and row["live"] is not None:
                return int(name.split(".")[0]), row["live"]
        return 0, {}

    def _commit(self, after: int, live: dict[str, list[int]]) -> None:
        fs, where = self._file(f"{self.path}/versions/{after + 1:012d}.json")
        try:
            out = fs.create(where, False)
        except Exception as e:
            if fs.exists(where):
                raise Conflict(f"version {after + 1} is there already") from e
            raise
        out.write(bytearray(json.dumps({"live": {k: sorted(v) for k, v in live.items() if v}}), "utf-8"))
        out.close()

    def _bucket(self, key: str = "id"):
        return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(self.buckets)).cast("int")

    def _rows(self, live: dict[str, list[int]]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for folder, some in live.items() for b in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, df: DataFrame) -> tuple[str, list[int]]:
        """A new folder with the rows, and its buckets. Tasks share out large buckets."""
        folder = f"data-{uuid.uuid4().hex}"
        conformed(df, self.schema).withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, where = self._file(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return folder, [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]

    def _changed(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the buckets of ``ids`` anew."""
        number, live = self.version()
        hit = {r["b"] for r in ids.select(self._bucket().alias("b")).distinct().collect()}  # at most `buckets`
        folder, some = self._written(change(self._rows({f: [b for b in bs if b in hit] for f, bs in live.items()})))
        self._commit(number, {f: [b for b in bs if b not in hit] for f, bs in live.items()} | {folder: some})

    def read(self) -> DataFrame:
        return self._rows(self.version()[1])

    def write(self, df: DataFrame) -> None:
        number, _ = self.version()
        folder, some = self._written(df)
        self._commit(number, {folder: some})

    def append(self, new: DataFrame) -> None:
        number, live = self.version()
        folder, some = self._written(new.withColumn("created_at", F.current_timestamp()))
        self._commit(number, {**live, folder: some})

    def update(self, changes: DataFrame, columns: list[str], order: str | None = None) -> None:
        self._changed(changes, lambda rows: updated(rows, changes, columns, order=order))

    def delete(self, ids: DataFrame) -> None:
        self._changed(ids, lambda rows: deleted(rows, ids))

    def clear(self) -> None:
        self._commit(self.version()[0], {})


def geocoded(rows: DataFrame, gazetteer: DataFrame, key: str = "id") -> DataFrame:
    """Coordinates, city and zip from a gazetteer by normalised address, else by the address without suite and the like; then the bounds check."""
    full = append_state(F.trim("address"))
    rows = rows.withColumn("__a", normalize_address(full)).withColumn("__b", normalize_address(simplify_address(full)))
    places = gazetteer.select(normalize_address(F.col("address")).alias("__k"), F.struct("address", "latitude", "longitude", "city", "zip_code").alias("__p"))
    first = places.select(F.col("__k").alias("__a"), F.col("__p").alias("__p1"))
    found = rows.join(first, "__a", "left")
    again = found.where("__p1 is null and __a <> __b").join(places.withColumnsRenamed({"__k": "__b", "__p": "__p2"}), "__b", "left")
    rest = found.where("__p1 is not null or __a = __b").withColumn("__p2", F.lit(None).cast(again.schema["__p2"].dataType))
    both = again.unionByName(rest)
    place = F.coalesce("__p1", "__p2")
    out = both.select(key, F.coalesce(place["address"], F.col("address")).alias("address"), place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), place["city"].alias("city"), place["zip_code"].alias("zip_code"),
                      F.when(F.col("__p1").isNotNull(), "full").when(F.col("__p2").isNotNull(), "simplified").otherwise("none").alias("matched"))
    return bounds_checked(out)


#: House numbers that are looked at together, and how far apart the known neighbours of an unknown number may be.
NUMBERS, GAP = 100, 400


def _houses(df: DataFrame, *keep: str) -> DataFrame:
    """``number, street`` of addresses that begin with a house number; the street is the rest of the normalised address, town and zip code included."""
    df = df.select(*keep, normalize_address(append_state(F.trim("address"))).alias("__whole"))
    parts = F.split("__whole", " ", 2)
    return df.where(F.col("__whole").rlike("^[0-9]{1,6} .")).select(*keep, parts[0].cast("int").alias("number"), parts[1].alias("street"))


def interpolated(rows: DataFrame, gazetteer: DataFrame, key: str = "id", gap: int = GAP) -> DataFrame:
    """``key, latitude, longitude, city, zip_code`` of addresses that lie between two known house numbers of their street, at most ``gap`` apart: in proportion to the numbers; city and zip code of the nearer, or lower, one.

    The neighbours come from an as-of join: known and unknown numbers of a street are sorted together, ``NUMBERS`` numbers at a time, so a street of any length is dealt out, and what a block lacks comes from the
    first and last known number of the blocks around it. Each number of a street is worked out once, however many rows have it. Addresses without a house number, and those with a neighbour on one side only, are left out.
    """
    place = ["number", "latitude", "longitude", "city", "zip_code"]
    known = _houses(gazetteer, "latitude", "longitude", "city", "zip_code").where("latitude is not null and longitude is not null")
    known = known.groupBy("street", "number").agg(F.min(F.struct("latitude", "longitude", "city", "zip_code")).alias("p"))
    known = known.select("street", "number", F.struct("number", "p.latitude", "p.longitude", "p.city", "p.zip_code").alias("place"))
    wanted = _houses(rows, key)
    asked = wanted.select("street", "number").distinct().withColumn("place", F.lit(None).cast(known.schema["place"].dataType))
    both = known.unionByName(asked).withColumn("block", F.floor(F.col("number") / NUMBERS))
    w = W.partitionBy("street", "block").orderBy("number", F.col("place").isNull())
    near = both.withColumn("below", F.last("place", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("above", F.first("place", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    ends = both.groupBy("street", "block").agg(F.min("place").alias("least"), F.max("place").alias("most"))  # structs compare by number first
    w = W.partitionBy("street").orderBy("block")
    ends = ends.select("street", "block", F.last("most", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("least", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    near = near.where("place is null").join(ends, ["street", "block"])
    near = near.select("street", "number", F.coalesce("below", "before").alias("a"), F.coalesce("above", "after").alias("b")).where(F.col("b.number") - F.col("a.number") <= gap)
    share = F.coalesce(F.try_divide(F.col("number") - F.col("a.number"), F.col("b.number") - F.col("a.number")), F.lit(0.0))
    between = lambda c: (F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    nearer = lambda c: F.when(share <= 0.5, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    found = near.select("street", F.col("number"), between(place[1]), between(place[2]), nearer(place[3]), nearer(place[4]))
    return wanted.join(found, ["street", "number"]).select(key, *place[1:])


def geocoded_between(rows: DataFrame, gazetteer: DataFrame, key: str = "id", gap: int = GAP) -> DataFrame:
    """As ``geocoded``; addresses that the gazetteer lacks are placed between their neighbours, ``matched`` being 'interpolated'. Runs a job that writes the rows with what the gazetteer has."""
    found = kept(geocoded(rows, gazetteer, key), "geocoded")
    rest = found.where("matched = 'none'")
    between = interpolated(rest.select(key, "address"), gazetteer, key, gap).withColumnsRenamed({c: f"__{c}" for c in ("latitude", "longitude", "city", "zip_code")})
    placed = rest.join(between, key, "left").withColumn("matched", F.when(F.col("__latitude").isNotNull(), "interpolated").otherwise("none"))
    placed = bounds_checked(placed.select(key, "address", *[F.coalesce(f"__{c}", c).alias(c) for c in ("latitude", "longitude", "city", "zip_code")], "matched"))
    return found.where("matched <> 'none'").unionByName(placed)


def component(components: Column, kind: str) -> Column:
    """The long name of the last address component of a kind."""
    return F.try_element_at(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(-1))["long_name"]
