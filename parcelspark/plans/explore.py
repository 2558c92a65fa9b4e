"""Registered queries: scalars, filters, geography, statistics and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, geo
from ..operators import filters as f
from ..operators import radius, rates, stats
from ..operators.filters import Filter
from ..sources.views import view, with_views


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sale_comps")


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lease_comps")


QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = with_views(sql)
        return fn
    return put


_SPACE = r"\s\v\x{{001C}}-\x{{001F}}\x{{0085}}\p{{Z}}"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(lower({{c}}), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}_{_SPACE}]', '', 'g'), '[{_SPACE}]+', ' ', 'g')"
for _long, _short in clean.ABBREVIATIONS:
    NORMAL = f"regexp_replace({NORMAL}, '\\b{_long}\\b', '{_short}', 'g')"

_RAW = r"trim(regexp_replace(raw, '[\s\x{00A0}]+', ' ', 'g'))"
_CUT = f"regexp_replace({_RAW}, 'sf|SF|[,$]', '', 'g')"
_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


@query(rf"""
    WITH t AS (SELECT id, raw, {_RAW} AS t, {_CUT} AS s FROM raw_values),
    p AS (SELECT *, regexp_extract(s, '^([0-9.]+)\s*%', 1) AS pct, regexp_extract(s, '^([0-9.]+)\s*/\s*\w+', 1) AS unit, regexp_extract(s, '(?s)^([^0-9]*)([0-9]+\.?[0-9]*)(.*)$', 2) AS run,
                 length(trim(regexp_extract(s, '(?s)^([^0-9]*)([0-9]+\.?[0-9]*)(.*)$', 1) || regexp_extract(s, '(?s)^([^0-9]*)([0-9]+\.?[0-9]*)(.*)$', 3))) AS rest FROM t)
    SELECT id, raw, round(CASE WHEN t IN ('', '-', '_', '--', 'N/A', 'n/a', 'nan', 'None', 'TBD', 'tbd') THEN NULL WHEN pct <> '' THEN CASE WHEN regexp_matches(pct, {_NUM}) THEN CAST(pct AS DOUBLE) END
        ELSE coalesce(CASE WHEN regexp_matches(unit, {_NUM}) THEN CAST(unit AS DOUBLE) END, CASE WHEN regexp_matches(trim(s), {_NUM}) THEN TRY_CAST(trim(s) AS DOUBLE) END,
                      CASE WHEN run <> '' AND (length(run) >= 2 OR rest <= 2 * length(run)) THEN CAST(run AS DOUBLE) END) END, 2) AS value FROM p""")
def scalar_to_float(spark, sf_dir):
    return view(spark, sf_dir, "raw_values").select("id", "raw", clean.to_float_2(F.col("raw")).alias("value"))


@query(rf"""SELECT id, round(CASE WHEN regexp_matches(c, {_NUM}) THEN CAST(c AS DOUBLE) END, 2) + 0.0 AS value FROM (SELECT id, trim(regexp_replace(lower({_RAW}), 'sf|[,$%]', '', 'g')) AS c FROM raw_values)""")
def scalar_currency(spark, sf_dir):
    return view(spark, sf_dir, "raw_values").select("id", clean.currency(F.col("raw")).alias("value"))


@query(r"""SELECT file_no, col_idx, trim(regexp_replace(regexp_replace(translate(lower(header), '_.', '  '), '[^a-z0-9_\s/]', '', 'g'), '\s+', ' ', 'g')) AS header FROM header_cells""")
def scalar_clean_header(spark, sf_dir):
    return view(spark, sf_dir, "header_cells").select("file_no", "col_idx", clean.clean_header(F.col("header")).alias("header"))


@query(f"SELECT new_id AS id, {NORMAL.format(c='address')} AS normalized FROM new_listings UNION ALL SELECT new_id, {NORMAL.format(c='address')} FROM listing_batch UNION ALL SELECT id, {NORMAL.format(c='address')} FROM lease_comps")
def scalar_normalize_address(spark, sf_dir):
    both = view(spark, sf_dir, "new_listings").union(view(spark, sf_dir, "listing_batch")).select(F.col("new_id").alias("id"), "address").union(_leases(spark, sf_dir).select("id", "address"))
    return both.select("id", clean.normalize_address(F.col("address")).alias("normalized"))


@query(r"""SELECT id, nullif(regexp_extract(address, '\b([0-9]{5})\b', 1), '') AS zip, nullif(trim(regexp_extract(address, '(?i),\s*([A-Za-z\s]+?),\s*(?:TX|Texas)\b', 1)), '') AS city,
    regexp_replace(trim(regexp_replace(address || ' Suite #' || CAST(id % 90 AS VARCHAR), '(?i)\b(suite|ste|unit|bldg|building|floor|fl)\s*[#]?\s*\w+', '', 'g')), '\s+', ' ', 'g') AS simplified,
    CASE WHEN id % 2 = 0 THEN address ELSE split_part(address, ',', 1) || ', TX' END AS with_state, regexp_replace(substr(address, 1, 40), 'x^', '') AS label, trim(notes) AS notes FROM sale_comps""")
def scalar_zip_city(spark, sf_dir):
    a = F.col("address")
    return _sales(spark, sf_dir).select("id", clean.extract_zip(a).alias("zip"), clean.extract_city(a).alias("city"), clean.simplify_address(F.concat(a, F.lit(" Suite #"), F.col("id") % 90)).alias("simplified"),
                                        clean.append_state(F.when(F.col("id") % 2 == 0, a).otherwise(F.substring_index(a, ",", 1))).alias("with_state"), clean.truncated(a, 40).alias("label"), clean.text_value(F.col("notes")).alias("notes"))


@query("""WITH d AS (SELECT id, closing_date AS dt FROM sale_comps) SELECT id, dt AS parsed, round(date_diff('day', dt, DATE '2002-01-01') / 365.25, 6) AS age_years FROM d""")
def scalar_dates(spark, sf_dir):
    d, k = F.col("closing_date"), F.col("id") % 3
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMM d, yyyy"))
    found = clean.parse_date(text)
    return _sales(spark, sf_dir).select("id", found.alias("parsed"), F.round(clean.age_years(found, F.lit("2002-01-01").cast("date")), 6).alias("age_years"))


@query("""SELECT id, sale_price, building_size, city FROM sale_comps WHERE sale_price >= 100000 AND sale_price <= 300000 AND building_size >= 5000 AND year_built <= 2010
    AND regexp_matches(address, '(?i)airport|eastex') AND city IN ('Humble', 'Tomball') AND closing_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def filter_conjunction(spark, sf_dir):
    return f.filtered(_sales(spark, sf_dir), [
        Filter("sale_price", "range", 100000, 300000), Filter("building_size", "range", 5000), Filter("year_built", "range", high=2010), Filter("address", "text", "airport|eastex"),
        Filter("city", "any_of", values=("Humble", "Tomball")), Filter("closing_date", "dates", "1996-01-01", "2000-12-31"), Filter("clear_height", "range", 24)]).select("id", "sale_price", "building_size", "city")


@query("SELECT id, address FROM lease_comps WHERE regexp_matches(address, '(?i)^1[0-9]{2} .*drive')")
def filter_text_regex(spark, sf_dir):
    return f.filtered(_leases(spark, sf_dir), [Filter("address", "text", "^1[0-9]{2} .*drive")]).select("id", "address")


@query("SELECT id, zip_code, lease_type FROM lease_comps WHERE zip_code IN ('77001', '77002') AND lease_type IN ('NNN') AND contains(lower(address), 'houston')")
def filter_categorical(spark, sf_dir):
    return f.filtered(_leases(spark, sf_dir), [Filter("zip_code", "any_of", values=("77001", "77002")), Filter("lease_type", "any_of", values=("NNN",)), Filter("address", "literal", "HOUSTON")]).select("id", "zip_code", "lease_type")


@query("SELECT id, closing_date FROM sale_comps WHERE closing_date >= DATE '1997-03-01' AND closing_date <= DATE '1998-03-01'")
def filter_date_typed(spark, sf_dir):
    return f.filtered(_sales(spark, sf_dir), [Filter("closing_date", "dates", "1997-03-01", "1998-03-01")]).select("id", "closing_date")


@query("SELECT id, closing_date FROM sale_comps WHERE strftime(closing_date, '%m/%d/%Y') >= '03/01/1997' AND strftime(closing_date, '%m/%d/%Y') <= '09/01/1998'")
def filter_date_lexicographic(spark, sf_dir):
    shown = _sales(spark, sf_dir).withColumn("shown", F.date_format("closing_date", "MM/dd/yyyy"))
    return f.filtered(shown, [Filter("shown", "lexicographic_dates", "03/01/1997", "09/01/1998")]).select("id", "closing_date")


@query("SELECT DISTINCT building_type AS option FROM lease_comps WHERE trim(building_type) <> ''")
def distinct_options(spark, sf_dir):
    return f.options(_leases(spark, sf_dir), "building_type")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high FROM sale_comps" for c in ("sale_price", "building_size", "year_built", "cap_rate")))
def column_ranges(spark, sf_dir):
    return f.ranges(_sales(spark, sf_dir), ["sale_price", "building_size", "year_built", "cap_rate"])


@query("SELECT id, year_built, row_number() OVER (ORDER BY year_built DESC NULLS LAST, id) AS nth FROM sale_comps QUALIFY nth <= 15000")
def sort_nulls_last(spark, sf_dir):
    return f.positioned(_sales(spark, sf_dir).select("id", "year_built"), "year_built", True)


@query("SELECT id, sale_price FROM sale_comps ORDER BY sale_price DESC NULLS LAST, id LIMIT 100 OFFSET 200")
def page_k(spark, sf_dir):
    return f.page(_sales(spark, sf_dir), "sale_price", 3, True).select("id", "sale_price")


@query("SELECT id, year_built FROM sale_comps WHERE (year_built > 1999 OR (year_built = 1999 AND id > 5000) OR year_built IS NULL) ORDER BY year_built ASC NULLS LAST, id LIMIT 100")
def page_keyset(spark, sf_dir):
    return f.page_after(_sales(spark, sf_dir), "year_built", 1999.0, 5000).select("id", "year_built")


@query("SELECT id, CAST(id AS VARCHAR) || ': ' || address[1:60] AS label FROM sale_comps WHERE id IN (SELECT s_suppkey FROM supplier)")
def select_by_id(spark, sf_dir):
    return f.selected(_sales(spark, sf_dir), view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "label")


def _a(lat: str, lng: str) -> str:
    a = f"pow(sin(radians(latitude - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(latitude)) * pow(sin(radians(longitude - {lng}) / 2), 2)"
    return f"3958.8 * 2 * atan2(sqrt({a}), sqrt(1 - ({a})))"


@query(f"SELECT id, round({_a('29.76', '(-95.37)')}, 4) AS distance_miles FROM sale_comps WHERE {_a('29.76', '(-95.37)')} <= 5.0")
def radius_filter(spark, sf_dir):
    return radius.within_radius(_sales(spark, sf_dir), 29.76, -95.37).select("id", F.round("distance_miles", 4).alias("distance_miles"))


@query(f"""WITH s AS (SELECT subject_id, latitude AS s_lat, longitude AS s_lng FROM subjects), p AS (SELECT subject_id, id, {_a('s_lat', 's_lng')} AS d FROM sale_comps CROSS JOIN s)
    SELECT subject_id, id, round(d, 4) AS distance_miles FROM p WHERE d <= 5.0""")
def radius_join_many(spark, sf_dir):
    return radius.radius_join(_sales(spark, sf_dir), view(spark, sf_dir, "subjects"), digits=4).select("subject_id", "id", "distance_miles")


@query("""WITH g AS (SELECT id, address, latitude + (id % 11) AS latitude, longitude FROM sale_comps)
    SELECT id, CASE WHEN ok THEN latitude END AS latitude, CASE WHEN ok THEN longitude END AS longitude, CASE WHEN NOT ok THEN 'Address geocoded outside Texas: ' || address END AS warning
    FROM (SELECT *, latitude BETWEEN 25.84 AND 36.50 AND longitude BETWEEN -106.65 AND -93.51 AS ok FROM g)""")
def bounds_validate(spark, sf_dir):
    moved = _sales(spark, sf_dir).withColumn("latitude", F.col("latitude") + F.col("id") % 11)
    return radius.bounds_checked(moved).select("id", "latitude", "longitude", "warning")


@query("""SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS cell_y, CAST(floor(longitude / 0.05) AS BIGINT) AS cell_x, round(sum(price_per_sf), 4) AS weight, count(*) AS n FROM sale_comps WHERE price_per_sf IS NOT NULL GROUP BY ALL""")
def density_grid(spark, sf_dir):
    return radius.density(_sales(spark, sf_dir), "price_per_sf").withColumn("weight", F.round("weight", 4))


@query("""WITH c AS (SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS y, CAST(floor(longitude / 0.05) AS BIGINT) AS x, sum(price_per_sf) AS w FROM sale_comps WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND price_per_sf IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT a.v AS dy, b.v AS dx, pow(1 - (a.v * a.v + b.v * b.v) / 16.0, 2) AS k FROM (SELECT unnest(generate_series(-3, 3)) AS v) AS a, (SELECT unnest(generate_series(-3, 3)) AS v) AS b WHERE a.v * a.v + b.v * b.v < 16)
    SELECT y + dy AS cell_y, x + dx AS cell_x, round(sum(w * k), 3) AS heat FROM c CROSS JOIN o GROUP BY 1, 2""")
def density_smoothed(spark, sf_dir):
    return radius.smoothed(radius.density(_sales(spark, sf_dir), "price_per_sf")).withColumn("heat", F.round("heat", 3))


@query("SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM sale_comps")
def map_center(spark, sf_dir):
    return radius.center(_sales(spark, sf_dir)).select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("SELECT count(*) AS n, round(avg(sale_price), 2) AS avg_sale_price, round(avg(price_per_sf), 2) AS avg_price_per_sf, round(avg(building_size), 2) AS avg_building_size FROM sale_comps")
def kpi_sales(spark, sf_dir):
    return stats.kpis(_sales(spark, sf_dir), ["sale_price", "price_per_sf", "building_size"])


_LR = """l AS (SELECT *, round(CASE WHEN rate_header LIKE '%/mo%' THEN rate_psf ELSE rate_psf / 12 END, 2) AS rate_monthly, round(CASE WHEN rate_header LIKE '%/mo%' THEN rate_psf * 12 ELSE rate_psf END, 2) AS rate_annually FROM lease_comps)"""


def _rated(spark, sf_dir):
    return rates.with_rates(_leases(spark, sf_dir), "batch")


@query(f"WITH {_LR} SELECT count(*) AS n, round(avg(rate_monthly), 2) AS avg_rate_monthly, round(avg(rate_annually), 2) AS avg_rate_annually, round(avg(leased_sf), 2) AS avg_leased_sf FROM l")
def kpi_leases(spark, sf_dir):
    return stats.kpis(_rated(spark, sf_dir), ["rate_monthly", "rate_annually", "leased_sf"])


@query("SELECT zip_code, count(sale_price) AS n, round(avg(sale_price), 2) AS avg_sale_price, round(avg(price_per_sf), 2) AS avg_price_per_sf, round(avg(building_size), 2) AS avg_building_size FROM sale_comps WHERE zip_code IS NOT NULL GROUP BY zip_code")
def zip_stats_sales(spark, sf_dir):
    return stats.by_zip(_sales(spark, sf_dir), ["sale_price", "price_per_sf", "building_size"])


@query(f"WITH {_LR} SELECT zip_code, count(rate_monthly) AS n, round(avg(rate_monthly), 2) AS avg_rate_monthly, round(avg(rate_annually), 2) AS avg_rate_annually, round(avg(leased_sf), 2) AS avg_leased_sf FROM l GROUP BY zip_code")
def zip_stats_leases(spark, sf_dir):
    return stats.by_zip(_rated(spark, sf_dir), ["rate_monthly", "rate_annually", "leased_sf"])


@query("SELECT zip_code, count(sale_price) AS n, round(avg(sale_price), 2) AS avg_sale_price FROM sale_comps WHERE zip_code IN ('77003', '77017', '77030') GROUP BY zip_code")
def zip_compare(spark, sf_dir):
    chosen = _sales(spark, sf_dir).where(F.col("zip_code").isin("77003", "77017", "77030"))
    return stats.by_zip(chosen, ["sale_price"])


def _hist_sql(value: str, table: str, bins: int) -> str:
    return f"""WITH k AS (SELECT {value} AS x FROM {table} WHERE {value} IS NOT NULL), e AS (SELECT min(x) AS low, max(x) AS high FROM k),
        c AS (SELECT least(coalesce(CAST(floor((x - low) / nullif(high - low, 0) * {bins}) AS BIGINT), 0), {bins - 1}) AS bin, count(*) AS n FROM k, e GROUP BY 1)
        SELECT b.bin, round(low + (high - low) * b.bin / {bins}, 4) AS from_value, coalesce(n, 0) AS n FROM e, (SELECT unnest(range({bins})) AS bin) AS b LEFT JOIN c ON c.bin = b.bin"""


@query(_hist_sql("sale_price", "sale_comps", 20))
def histogram_price(spark, sf_dir):
    return stats.histogram(_sales(spark, sf_dir), "sale_price")


@query(_hist_sql("ti", "(SELECT CAST(regexp_replace(ti_raw, '[$ ]', '', 'g') AS DOUBLE) AS ti FROM lease_comps)", 15))
def histogram_ti15(spark, sf_dir):
    return stats.histogram(_leases(spark, sf_dir).withColumn("ti", clean.to_float_2(F.col("ti_raw"))), "ti", 15)


@query("SELECT round(regr_slope(sale_price, building_size), 6) AS slope, round(regr_intercept(sale_price, building_size), 3) AS intercept, round(regr_r2(sale_price, building_size), 6) AS r2, regr_count(sale_price, building_size) AS n FROM sale_comps")
def ols_price_size(spark, sf_dir):
    return stats.ols(_sales(spark, sf_dir), "building_size", "sale_price").select(F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(f"WITH {_LR} SELECT round(regr_slope(rate_annually, leased_sf), 8) AS slope, round(regr_intercept(rate_annually, leased_sf), 6) AS intercept, round(regr_r2(rate_annually, leased_sf), 6) AS r2, regr_count(rate_annually, leased_sf) AS n FROM l")
def ols_rate_size(spark, sf_dir):
    return stats.ols(_rated(spark, sf_dir), "leased_sf", "rate_annually").select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


def _loess_sql(date: str, value: str, table: str, more: str = "") -> str:
    return f"""WITH {more} d AS (SELECT date_diff('day', DATE '1970-01-01', {date}) AS day, count(*) AS n, sum({value}) AS total FROM {table} WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1),
        e AS (SELECT min(day) AS low, max(day) AS high FROM d), g AS (SELECT point, low + (high - low) * point / 23.0 AS x0, (high - low) * 0.3 AS h FROM e, (SELECT unnest(range(24)) AS point)),
        w AS (SELECT point, x0, day - x0 AS u, pow(1 - pow(abs(day - x0) / h, 3), 3) AS w, n, total FROM d JOIN g ON abs(day - x0) < h),
        s AS (SELECT point, x0, sum(w * n) AS s0, sum(w * n * u) AS s1, sum(w * n * u * u) AS s2, sum(w * total) AS t0, sum(w * total * u) AS t1 FROM w GROUP BY ALL)
        SELECT point, round(x0, 3) AS day, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 3) AS fitted FROM s"""


@query(_loess_sql("closing_date", "price_per_sf", "sale_comps"))
def loess_psf_time(spark, sf_dir):
    return stats.loess(_sales(spark, sf_dir), "closing_date", "price_per_sf")


@query(_loess_sql("commencement_date", "rate_monthly", "l", _LR + ","))
def loess_rent_time(spark, sf_dir):
    return stats.loess(_rated(spark, sf_dir), "commencement_date", "rate_monthly")


def _lowess_sql(date: str, value: str, table: str, more: str = "", rounds: int = 3) -> str:
    """Row by row where the query works day by day: positions of all rows, and the neighbourhood's first row from pairs of rows k apart."""
    parts = [f"o AS MATERIALIZED (SELECT date_diff('day', DATE '1970-01-01', {date}) AS day, CAST({value} AS DOUBLE) AS y FROM {table} WHERE {date} IS NOT NULL AND {value} IS NOT NULL)",
             "xs AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM o)", "z AS (SELECT count(*) AS size, greatest(1, CAST(floor(2.0::DOUBLE / 3 * count(*) + 1e-10) AS BIGINT)) AS k FROM o)",
             "ds AS MATERIALIZED (SELECT day, min(pos) AS start, max(pos) AS last, count(*) AS n FROM xs GROUP BY day)", "p AS (SELECT a.day + b.day AS s, min(a.pos) AS l FROM z, xs AS a JOIN xs AS b ON b.pos = a.pos + z.k GROUP BY 1)",
             "q AS (SELECT ds.day AS x0, coalesce(p.l, z.size - z.k) AS l, k FROM z, ds ASOF LEFT JOIN p ON 2 * ds.day <= p.s)",
             "hs AS (SELECT x0, l, l + k - 1 AS e, greatest(x0 - a.day, b.day - x0) AS h FROM q JOIN xs AS a ON a.pos = l JOIN xs AS b ON b.pos = l + k - 1)",
             "ne AS MATERIALIZED (SELECT x0, day, day - x0 AS u, (least(e, last) - greatest(l, start) + 1) / n * CASE WHEN h = 0 THEN 1.0 ELSE pow(1 - pow(abs(day - x0) / h, 3), 3) END::DOUBLE AS w FROM hs JOIN ds ON last >= l AND start <= e)", "w0 AS (SELECT day, y, 1.0::DOUBLE AS r FROM o)"]
    for i in range(rounds + 1):
        parts += [f"t{i} AS (SELECT day, sum(r) AS rn, sum(r * y) AS ry FROM w{i} GROUP BY day)",
                  f"e{i} AS (SELECT x0, sum(w * rn) AS s0, sum(w * rn * u) AS s1, sum(w * rn * u * u) AS s2, sum(w * ry) AS t0, sum(w * ry * u) AS t1 FROM ne JOIN t{i} USING (day) GROUP BY x0)",
                  f"f{i} AS MATERIALIZED (SELECT x0 AS day, coalesce(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, t0 / nullif(s0, 0)) AS fitted FROM e{i})",
                  f"r{i} AS MATERIALIZED (SELECT day, y, abs(y - coalesce(fitted, y)) AS off FROM o JOIN f{i} USING (day))", f"m{i} AS (SELECT quantile_disc(off, 0.5) AS m FROM r{i})",
                  f"v{i} AS (SELECT day, y, CASE WHEN m = 0 THEN CASE WHEN off > 0 THEN 1.0 ELSE 0.0 END ELSE off / (6 * m) END AS part FROM r{i}, m{i})",
                  f"w{i + 1} AS (SELECT day, y, CASE WHEN part >= 0.999 THEN 0.0 WHEN part <= 0.001 THEN 1.0 ELSE pow(1 - part * part, 2) END AS r FROM v{i})"]
    return f"WITH {more} {', '.join(parts)} SELECT day, round(fitted, 3) AS fitted FROM f{rounds}"


@query(_lowess_sql("closing_date", "price_per_sf", "sale_comps"))
def lowess_psf_time(spark, sf_dir):
    return stats.lowess(_sales(spark, sf_dir), "closing_date", "price_per_sf").select("day", F.round("fitted", 3).alias("fitted"))


@query(_lowess_sql("commencement_date", "rate_monthly", "l", _LR + ","))
def lowess_rent_time(spark, sf_dir):
    return stats.lowess(_rated(spark, sf_dir), "commencement_date", "rate_monthly").select("day", F.round("fitted", 3).alias("fitted"))


@query("""WITH t AS (SELECT * FROM sale_comps ORDER BY sale_price DESC, id LIMIT 3), r AS (SELECT *, row_number() OVER (ORDER BY sale_price DESC, id) AS nth FROM t)
    SELECT field, max(value) FILTER (WHERE nth = 1) AS first, max(value) FILTER (WHERE nth = 2) AS second, max(value) FILTER (WHERE nth = 3) AS third
    FROM (SELECT nth, 'id' AS field, CAST(id AS VARCHAR) AS value FROM r UNION ALL SELECT nth, 'city', city FROM r UNION ALL SELECT nth, 'zip_code', zip_code FROM r UNION ALL SELECT nth, 'closing_date', CAST(closing_date AS VARCHAR) FROM r) GROUP BY field""")
def compare_transpose(spark, sf_dir):
    from pyspark.sql import Window as W
    top = _sales(spark, sf_dir).orderBy(F.col("sale_price").desc(), "id").limit(3)
    top = top.withColumn("label", F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third")), F.row_number().over(W.orderBy(F.col("sale_price").desc(), "id"))))
    return stats.transposed(top, ["id", "city", "zip_code", "closing_date"], ["first", "second", "third"])


@query("""WITH h AS (SELECT id, CASE id % 6 WHEN 0 THEN 'Rate PSF/Mo' WHEN 1 THEN 'Rent p.a.' WHEN 2 THEN 'Base Rate' WHEN 3 THEN rate_header WHEN 4 THEN 'Annual or Monthly Rent' ELSE 'NNN/SF/YR' END AS h FROM lease_comps)
    SELECT id, CASE WHEN regexp_matches(lower(h), 'monthly|/mo|per month| mo | mo\\.|per mo|/month') THEN 'monthly' WHEN regexp_matches(lower(h), 'annual|yearly|/yr|per year| yr | yr\\.|per annum|/year|p\\.a\\.') THEN 'annual' END AS unit FROM h""")
def rate_unit_header(spark, sf_dir):
    k = F.col("id") % 6
    header = F.when(k == 0, "Rate PSF/Mo").when(k == 1, "Rent p.a.").when(k == 2, "Base Rate").when(k == 3, F.col("rate_header")).when(k == 4, "Annual or Monthly Rent").otherwise("NNN/SF/YR")
    return _leases(spark, sf_dir).select("id", rates.unit_from_header(header).alias("unit"))


@query("SELECT batch, rate_psf AS upper_median FROM (SELECT batch, rate_psf, row_number() OVER (PARTITION BY batch ORDER BY rate_psf) AS nth, count(*) OVER (PARTITION BY batch) AS n FROM lease_comps WHERE rate_psf > 0) WHERE nth = n // 2 + 1")
def rate_upper_median(spark, sf_dir):
    return rates.upper_median(_leases(spark, sf_dir), "batch", "rate_psf")


@query("""WITH h AS (SELECT id, batch, CASE WHEN batch % 7 = 0 THEN 0.0 ELSE rate_psf END AS rate, CASE WHEN batch % 3 = 0 THEN rate_header ELSE 'Base Rate' END AS header FROM lease_comps),
    u AS (SELECT *, CASE WHEN lower(header) LIKE '%/mo%' THEN 'monthly' WHEN lower(header) LIKE '%yearly%' THEN 'annual' END AS hint FROM h),
    m AS (SELECT batch, rate AS med FROM (SELECT batch, rate, row_number() OVER (PARTITION BY batch ORDER BY rate) AS nth, count(*) OVER (PARTITION BY batch) AS n FROM u WHERE rate > 0 AND hint IS NULL) WHERE nth = n // 2 + 1),
    f AS (SELECT id, rate, coalesce(hint, CASE WHEN med <= 4.0 THEN 'monthly' WHEN med IS NOT NULL THEN 'annual' END) AS whole, CASE WHEN rate <= 4.0 THEN 'monthly' ELSE 'annual' END AS own FROM u LEFT JOIN m USING (batch))
    SELECT id, round(CASE coalesce(whole, own) WHEN 'monthly' THEN rate ELSE rate / 12 END, 2) AS rate_monthly, round(CASE coalesce(whole, own) WHEN 'monthly' THEN rate * 12 ELSE rate END, 2) AS rate_annually,
           CASE WHEN whole IS NOT NULL THEN whole || '_from_header' ELSE own || '_inferred' END AS rate_basis FROM f""")
def rate_split(spark, sf_dir):
    rows = _leases(spark, sf_dir).withColumn("rate_psf", F.when(F.col("batch") % 7 == 0, 0.0).otherwise(F.col("rate_psf"))).withColumn("rate_header", F.when(F.col("batch") % 3 == 0, F.col("rate_header")).otherwise("Base Rate"))
    return rates.with_rates(rows, "batch").select("id", "rate_monthly", "rate_annually", "rate_basis")


@query("SELECT id, round(coalesce(price_per_sf, round(sale_price / nullif(building_size, 0), 2)), 2) AS price_per_sf FROM sale_comps")
def psf_fill(spark, sf_dir):
    return _sales(spark, sf_dir).select("id", F.round(rates.fill_price_per_sf(F.col("sale_price"), F.col("building_size"), F.col("price_per_sf")), 2).alias("price_per_sf"))
