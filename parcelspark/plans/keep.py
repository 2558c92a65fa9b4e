"""Registered queries: duplicates, store, geocoding and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import duplicates as d
from ..operators import export, filters, store
from ..sources.scratch import folder
from ..sources.views import view, with_views
from .explore import NORMAL

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = with_views(sql)
        return fn
    return put


def _both(spark, sf_dir):
    return view(spark, sf_dir, "listing_batch"), view(spark, sf_dir, "sale_comps").select("id", "address")


def _stored(spark, sf_dir, name):
    """A new store with all sales in it."""
    sales = store.Store(spark, folder(spark, name), store.SALE)
    sales.append(view(spark, sf_dir, "sale_comps").drop("closing_date"))
    return sales


_N = f"n AS (SELECT new_id, address AS na, {NORMAL.format(c='address')} AS a FROM listing_batch), e AS (SELECT id AS existing_id, address AS ea, {NORMAL.format(c='address')} AS b FROM sale_comps)"
_LEAST = "list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))))"
# the longest prefix of each end of x that y holds; of equal lengths the first
_RUN = "list_max(list_transform(generate_series(1, length(x)), lambda i: {{'l': coalesce(list_max(list_filter(generate_series(1, length(x) - i + 1), lambda l: contains(y, x[i:i + l - 1]))), 0), 'k': -i}}))".replace("{{", "{").replace("}}", "}")
# matching blocks: the longest common run, then the same to its left and right; pairs that share too few characters for 0.85 are left out first
_RATIO = f"""{_N}, d AS (SELECT DISTINCT x.a, y.b FROM (SELECT DISTINCT a FROM n WHERE a <> '') AS x JOIN (SELECT DISTINCT b FROM e WHERE b <> '') AS y ON 2 * least(length(a), length(b)) >= 0.85 * (length(a) + length(b)) - 1e-9),
    c AS (SELECT a, b FROM d WHERE 2 * {_LEAST} >= 0.85 * (length(a) + length(b)) - 1e-9),
    blocks AS (SELECT a, b, a AS x, b AS y, 0 AS m FROM c UNION ALL
        SELECT a, b, CASE side WHEN 1 THEN x[1:i - 1] ELSE x[i + l:] END AS x, CASE side WHEN 1 THEN y[1:j - 1] ELSE y[j + l:] END AS y, CASE side WHEN 1 THEN l ELSE 0 END AS m
        FROM (SELECT *, strpos(y, x[i:i + l - 1]) AS j FROM (SELECT a, b, x, y, run.l AS l, -run.k AS i FROM (SELECT a, b, x, y, {_RUN} AS run FROM blocks WHERE x <> '' AND y <> '') AS r WHERE run.l > 0) AS s) AS t, (SELECT unnest([1, 2]) AS side) AS u),
    r AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS score FROM blocks GROUP BY a, b HAVING score >= 0.85),
    p AS (SELECT new_id, existing_id, na, ea, score FROM r JOIN n USING (a) JOIN e USING (b))"""
_RATIO = "RECURSIVE " + _RATIO


@query(f"WITH {_N} SELECT new_id, existing_id FROM n JOIN e ON a = b AND a <> ''")
def dup_exact_normalized(spark, sf_dir):
    return d.exact(*_both(spark, sf_dir))


@query(f"WITH {_N} SELECT new_id, existing_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS score FROM n JOIN e ON least(length(a), length(b)) >= 0.85 * greatest(length(a), length(b)) AND 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85")
def dup_levenshtein_join(spark, sf_dir):
    return d.by_levenshtein(*_both(spark, sf_dir), digits=6)


@query(f"WITH {_RATIO} SELECT new_id, existing_id, round(score, 6) AS score FROM p")
def dup_ratio_join(spark, sf_dir):
    return d.by_ratio(*_both(spark, sf_dir), digits=6)


@query(f"WITH {_RATIO} SELECT new_id, na AS address FROM n WHERE new_id NOT IN (SELECT new_id FROM p)")
def save_anti_join(spark, sf_dir):
    new, stored = _both(spark, sf_dir)
    return d.without_duplicates(new, d.best(new, stored)).select("new_id", "address")


@query(f"""WITH {_RATIO} SELECT new_id, existing_id, round(100 * score, 1) AS score_pct, na[1:50] AS new_address, ea[1:50] AS existing_address FROM p
    QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY score DESC, existing_id) = 1""")
def dup_report(spark, sf_dir):
    new, stored = _both(spark, sf_dir)
    return d.report(new, stored, d.best(new, stored))


_G = f"""g AS (SELECT * FROM (SELECT id AS gid, address AS ga, latitude, longitude, city, zip_code, {NORMAL.format(c='address')} AS k FROM sale_comps WHERE id % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY k ORDER BY gid) = 1)"""


def _gazetteer(spark, sf_dir):
    known = view(spark, sf_dir, "sale_comps").where("id % 3 <> 0").withColumn("k", clean.normalize_address(F.col("address")))
    one = known.groupBy("k").agg(F.min(F.struct("id", "address", "latitude", "longitude", "city", "zip_code")).alias("p"))
    return one.select("p.address", "p.latitude", "p.longitude", "p.city", "p.zip_code")


@query(f"""WITH {_G} SELECT s.id, g.latitude, g.longitude, g.zip_code, CASE WHEN g.k IS NULL THEN 'none' ELSE 'full' END AS matched FROM sale_comps AS s LEFT JOIN g ON {NORMAL.format(c='s.address')} = g.k""")
def geocode_gazetteer(spark, sf_dir):
    return store.geocoded(view(spark, sf_dir, "sale_comps").select("id", "address"), _gazetteer(spark, sf_dir)).select("id", "latitude", "longitude", "zip_code", "matched")


@query(f"""WITH {_G} SELECT s.id, g.latitude, g.longitude, CASE WHEN g.k IS NULL THEN 'none' WHEN s.id % 2 = 0 THEN 'simplified' ELSE 'full' END AS matched FROM sale_comps AS s LEFT JOIN g ON {NORMAL.format(c='s.address')} = g.k""")
def geocode_retry_simplified(spark, sf_dir):
    rows = view(spark, sf_dir, "sale_comps").select("id", F.when(F.col("id") % 2 == 0, F.regexp_replace("address", ",", " Suite #12,")).otherwise(F.col("address")).alias("address"))
    rows = rows.withColumn("address", F.regexp_replace("address", r"(Suite #12,)(.*)Suite #12,", "$1$2,"))
    return store.geocoded(rows, _gazetteer(spark, sf_dir)).select("id", "latitude", "longitude", "matched")


_STREETS = f"""h AS (SELECT id, address, {NORMAL.format(c='address')} AS k, latitude, longitude, city, zip_code FROM sale_comps),
    t AS (SELECT *, CAST(regexp_extract(k, '^([0-9]+) (.+)$', 1) AS INTEGER) AS number, regexp_extract(k, '^([0-9]+) (.+)$', 2) AS street FROM h),
    g AS (SELECT street, number, latitude, longitude, city, zip_code FROM t WHERE number % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY street, number ORDER BY id) = 1),
    q AS (SELECT DISTINCT street, number FROM t WHERE number % 3 = 0),
    b AS (SELECT q.street, q.number, l.number AS ln, u.number AS un, (q.number - l.number) / (u.number - l.number) AS s, l.latitude AS la, u.latitude AS ua, l.longitude AS lo, u.longitude AS uo, l.zip_code AS lz, u.zip_code AS uz
          FROM q ASOF JOIN g AS l ON q.street = l.street AND q.number >= l.number ASOF JOIN g AS u ON q.street = u.street AND q.number <= u.number WHERE u.number - l.number <= 400)"""


@query(f"""WITH {_STREETS} SELECT t.id, round(coalesce(g.latitude, la + s * (ua - la)), 6) AS latitude, round(coalesce(g.longitude, lo + s * (uo - lo)), 6) AS longitude,
    coalesce(g.zip_code, CASE WHEN s <= 0.5 THEN lz ELSE uz END) AS zip_code, CASE WHEN g.number IS NOT NULL THEN 'full' WHEN b.number IS NOT NULL THEN 'interpolated' ELSE 'none' END AS matched
    FROM t LEFT JOIN g USING (street, number) LEFT JOIN b USING (street, number)""")
def geocode_interpolated(spark, sf_dir):
    """All sales against a gazetteer that lacks every third house number, which is what there is to find."""
    sales = view(spark, sf_dir, "sale_comps")
    known = sales.where("(100 + id % 900) % 3 <> 0").withColumn("k", clean.normalize_address(F.col("address")))
    one = known.groupBy("k").agg(F.min(F.struct("id", "address", "latitude", "longitude", "city", "zip_code")).alias("p")).select("p.address", "p.latitude", "p.longitude", "p.city", "p.zip_code")
    found = store.geocoded_between(sales.select("id", "address"), one)
    return found.select("id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "zip_code", "matched")


@query("SELECT id, CASE WHEN id % 7 <> 0 THEN city END AS city, zip_code FROM sale_comps")
def component_lookup(spark, sf_dir):
    part = lambda name, kind: F.struct(name.alias("long_name"), F.array(F.lit(kind), F.lit("political")).alias("types"))
    rows = view(spark, sf_dir, "sale_comps").withColumn("parts", F.array(part(F.lit("Elsewhere"), "postal_code"), part(F.col("city"), "locality"), part(F.col("zip_code"), "postal_code")))
    rows = rows.withColumn("parts", F.when(F.col("id") % 7 == 0, F.filter("parts", lambda p: ~F.array_contains(p["types"], "locality"))).otherwise(F.col("parts")))
    shape = "array<struct<long_name:string,types:array<string>>>"
    parsed = F.from_json(F.to_json("parts"), shape)
    return rows.select("id", store.component(parsed, "locality").alias("city"), store.component(parsed, "postal_code").alias("zip_code"))


@query("SELECT id, address, sale_price FROM sale_comps UNION ALL SELECT new_id + 10000000, address, NULL FROM new_listings")
def append_union(spark, sf_dir):
    new = view(spark, sf_dir, "new_listings").select((F.col("new_id") + 10000000).alias("id"), "address")
    return store.appended(view(spark, sf_dir, "sale_comps").select("id", "address", "sale_price"), new)


@query("SELECT id, CASE WHEN id % 50 = 0 THEN upper(city) ELSE city END AS city, CASE WHEN id % 50 = 0 THEN NULL ELSE sale_price END AS sale_price, zip_code FROM sale_comps")
def update_by_id(spark, sf_dir):
    """All sales in a store, some of them changed there."""
    sales = _stored(spark, sf_dir, "update-store")
    base = sales.read()
    sales.update(base.where("id % 50 = 0").select("id", F.upper("city").alias("city"), F.lit(None).cast("double").alias("sale_price")), ["city", "sale_price"])
    return sales.read().select("id", "city", "sale_price", "zip_code")


@query("SELECT id, address FROM sale_comps WHERE id NOT IN (SELECT new_id FROM new_listings)")
def delete_by_ids(spark, sf_dir):
    sales = _stored(spark, sf_dir, "delete-store")
    sales.delete(view(spark, sf_dir, "new_listings").select(F.col("new_id").alias("id")))
    return sales.read().select("id", "address")


@query("SELECT 'sale_comps' AS store, count(*) AS n, count(latitude) AS geocoded, count(*) - count(building_size) AS no_size FROM sale_comps UNION ALL SELECT 'lease_comps', count(*), count(latitude), count(*) - count(leased_sf) FROM lease_comps")
def record_counts(spark, sf_dir):
    one = lambda name, size: view(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count("latitude").alias("geocoded"), F.count_if(F.col(size).isNull()).alias("no_size")).select(F.lit(name).alias("store"), "n", "geocoded", "no_size")
    return one("sale_comps", "building_size").union(one("lease_comps", "leased_sf"))


@query("SELECT id, city, zip_code FROM (SELECT id, nullif(trim(regexp_extract(address, '(?i),\\s*([A-Za-z\\s]+?),\\s*(?:TX|Texas)\\b', 1)), '') AS city, CASE WHEN id % 4 = 0 THEN zip_code ELSE NULL END AS zip_code FROM sale_comps)")
def backfill_zip_city(spark, sf_dir):
    rows = view(spark, sf_dir, "sale_comps").select("id", "address", F.lit(None).cast("string").alias("city"), F.when(F.col("id") % 4 == 0, F.col("zip_code")).alias("zip_code"))
    return store.backfilled(rows).select("id", "city", "zip_code")


@query("SELECT id, round(CASE WHEN id % 9 <> 0 THEN sale_price END, 2) AS sale_price, round(price_per_sf, 2) AS price_per_sf, latitude, cap_rate FROM sale_comps")
def load_coerce_round(spark, sf_dir):
    rows = view(spark, sf_dir, "sale_comps").select("id", F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.col("sale_price").cast("string")).alias("sale_price"), "price_per_sf", "latitude", "cap_rate")
    return store.loaded(rows, ["sale_price"])


@query("""SELECT id, '<Placemark><name>' || replace(address, '&', '&amp;') || '</name><description>Size: ' || coalesce(CAST(CAST(floor(building_size) AS BIGINT) AS VARCHAR), 'N/A') || ', Price: ' || CAST(CAST(floor(sale_price) AS BIGINT) AS VARCHAR)
    || '</description><Point><coordinates>' || CAST(CAST(round(longitude, 6) AS DECIMAL(12,6)) AS VARCHAR) || ',' || CAST(CAST(round(latitude, 6) AS DECIMAL(12,6)) AS VARCHAR) || ',0</coordinates></Point></Placemark>' AS placemark FROM sale_comps""")
def kml_fragments(spark, sf_dir):
    return view(spark, sf_dir, "sale_comps").select("id", export.placemark(F.col("building_size"), F.col("sale_price")).alias("placemark"))


@query("""SELECT id, concat_ws(' | ', coalesce(address, 'N/A'), '$' || format('{:,}', CAST(round(sale_price) AS BIGINT)), format('{:,}', CAST(round(building_size) AS BIGINT)) || ' SF') AS popup FROM sale_comps""")
def popup_text(spark, sf_dir):
    rows = view(spark, sf_dir, "sale_comps").withColumn("sale_price", F.round("sale_price")).withColumn("distance_miles", F.lit(None).cast("double"))
    return export.popup(rows).select("id", "popup")


@query("SELECT 'sale_comps' AS store, CAST(0 AS INTEGER) AS n")
def delete_all(spark, sf_dir):
    """A store with all sales in it, cleared."""
    sales = _stored(spark, sf_dir, "clear-store")
    sales.clear()
    return sales.read().agg(F.count("*").cast("int").alias("n")).select(F.lit("sale_comps").alias("store"), "n")


@query("SELECT id, address, sale_price FROM sale_comps")
def project_columns(spark, sf_dir):
    return filters.projected(view(spark, sf_dir, "sale_comps").select("sale_price", "notes", "address", "id"), ["id", "address", "no such column"], hidden=("notes",))
