"""Property tables derived from the given tables, by SQL that Spark and DuckDB both run.

The given tables hold no property records, so sales and leases, subjects, listings, raw spreadsheet cells and the rest are formulas over
them; every row of the given tables takes part.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_STREET = "CASE {k} % 4 WHEN 0 THEN 'North Main Street' WHEN 1 THEN 'Airport Road' WHEN 2 THEN 'West Carrier Parkway' ELSE 'Eastex Highway' END"
_CITY = "CASE {k} % 6 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Humble' WHEN 2 THEN 'Cypress' WHEN 3 THEN 'Tomball' WHEN 4 THEN 'Katy' ELSE 'Spring' END"
_ZIP = "CAST(77000 + {k} % 40 AS STRING)"
_AT = "29.0 + CAST(({k} * 7919) % 1500 AS DOUBLE) / 1000.0 AS latitude, -96.0 + CAST(({j} * 104729) % 1300 AS DOUBLE) / 1000.0 AS longitude"

VIEWS = {
    "sale_comps": f"""
        SELECT o_orderkey AS id, CAST(100 + o_orderkey % 900 AS STRING) || ' ' || {_STREET.format(k="o_custkey")} || ', ' || {_CITY.format(k="o_custkey")} || ', TX ' || {_ZIP.format(k="o_custkey")} AS address,
               {_AT.format(k="o_orderkey", j="o_orderkey")}, o_totalprice AS sale_price, qty * 100.0 AS building_size,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / nullif(qty * 100.0, 0.0) END AS price_per_sf,
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS closing_date,
               CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1960 + o_orderkey % 65 AS DOUBLE) END AS year_built, CAST(o_orderkey % 80 AS DOUBLE) / 10.0 AS cap_rate,
               {_CITY.format(k="o_custkey")} AS city, {_ZIP.format(k="o_custkey")} AS zip_code, o_orderpriority AS notes, 'Buyer ' || CAST(o_custkey AS STRING) AS buyer
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) AS q ON l_orderkey = o_orderkey""",
    "lease_comps": f"""
        SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 32 + day(l_shipdate) AS id,
               CAST(100 + l_partkey % 900 AS STRING) || ' ' || p_name || ' Drive, Houston, TX ' || {_ZIP.format(k="l_suppkey")} AS address, {_AT.format(k="l_orderkey", j="l_partkey")},
               l_quantity * 1000.0 AS leased_sf, CASE WHEN l_partkey % 2 = 0 THEN 0.5 + l_discount * 10.0 ELSE 6.0 + l_tax * 100.0 END AS rate_psf,
               CASE WHEN l_partkey % 2 = 0 THEN 'Base Rate /mo' ELSE 'Base Rent Yearly' END AS rate_header, '$ ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || '.00 ' AS ti_raw,
               p_type AS building_type, CAST(12 + l_partkey % 110 AS DOUBLE) AS term_months, CAST(l_shipdate AS DATE) AS commencement_date,
               {_ZIP.format(k="l_suppkey")} AS zip_code, CASE WHEN l_partkey % 3 = 0 THEN 'NNN' WHEN l_partkey % 3 = 1 THEN 'Gross' END AS lease_type, l_suppkey AS batch
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "subjects": f"""
        SELECT s_suppkey AS subject_id, {_AT.format(k="s_suppkey", j="s_suppkey")}, 8000.0 + CAST(s_suppkey % 9 AS DOUBLE) * 1000.0 AS building_size,
               150000.0 + CAST(s_suppkey % 7 AS DOUBLE) * 25000.0 AS sale_price, CAST(1975 + s_suppkey % 40 AS DOUBLE) AS year_built FROM supplier""",
    "new_listings": """
        SELECT id AS new_id, replace(replace(upper(address), 'STREET', 'ST.'), 'ROAD', 'RD') || ' ' AS address FROM sale_comps WHERE id % 50 = 0""",
    "listing_batch": f"""
        SELECT s_suppkey AS new_id, CASE s_suppkey % 8
                 WHEN 0 THEN upper(a) WHEN 1 THEN replace(a, 'Road', 'Rd.') || '\u00a0' WHEN 2 THEN replace(replace(a, 'Street', 'Stret'), 'Highway', 'Hiway') WHEN 3 THEN replace(a, ' ', '\u00a0')
                 WHEN 4 THEN '\t' || replace(a, ', ', '\u2003 ') || '\n' WHEN 5 THEN replace(a, ',', ', Suite 9,') WHEN 6 THEN s_name || ' Plaza, El Paso' ELSE '# ' || replace(a, 'North', 'N') END AS address
        FROM (SELECT s_suppkey, s_name, CAST(100 + (s_suppkey * 37) % 1100 AS STRING) || ' ' || {_STREET.format(k="s_suppkey")} || ', ' || {_CITY.format(k="s_suppkey")} || ', TX ' || {_ZIP.format(k="s_suppkey")} AS a, s_suppkey AS k FROM supplier) AS b""",
    "raw_values": """
        SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN '$ ' || n || '.00 ' WHEN 1 THEN n || '.5%' WHEN 2 THEN '$' || n || '/acre Gross' WHEN 3 THEN 'Building ' || CAST(o_custkey % 10 AS STRING) || ' at Park'
               WHEN 4 THEN 'N/A' WHEN 5 THEN 'TBD' WHEN 6 THEN n || ' SF' WHEN 7 THEN '7/14/' || CAST(2000 + o_custkey % 25 AS STRING) WHEN 8 THEN '-' || CAST(o_custkey % 50 AS STRING) || '%'
               WHEN 9 THEN '\u00a0' || n || '\u00a0 ' WHEN 10 THEN '$ -   ' WHEN 11 THEN '1e' || CAST(o_custkey % 5 AS STRING) WHEN 12 THEN n || ' NNN est.' END AS raw
        FROM (SELECT o_orderkey, o_custkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS n FROM orders) AS o""",
    "file_rows": """
        SELECT c_custkey, CAST(floor(c_custkey / 20.0) AS BIGINT) AS file_no, c_custkey % 20 AS nth, CAST(floor(c_custkey / 20.0) AS BIGINT) % 6 AS layout, c_nationkey, CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) AS n, c_name FROM customer""",
    "header_cells": """
        SELECT f.file_no, layout, col_idx, CASE
                 WHEN layout = 5 THEN 'Field ' || CAST(col_idx AS STRING)
                 WHEN layout % 2 = 0 THEN CASE col_idx WHEN 0 THEN 'Property Address' WHEN 1 THEN 'Tenant' WHEN 2 THEN 'Leased_SF' WHEN 3 THEN 'Base Rent Yearly' WHEN 4 THEN 'Lease Term' WHEN 5 THEN 'TI Allowance' WHEN 6 THEN 'Notes' ELSE 'Notes' END
                 ELSE CASE col_idx WHEN 0 THEN 'Address' WHEN 1 THEN 'Buyer' WHEN 2 THEN 'Size' WHEN 3 THEN 'Sale Price' WHEN 4 THEN 'Price per S.F.' WHEN 5 THEN 'Cap Rate' WHEN 6 THEN 'Transaction Date' ELSE 'Comments' END END AS header
        FROM (SELECT DISTINCT file_no, layout FROM file_rows) AS f CROSS JOIN (SELECT DISTINCT CAST(n_nationkey % 8 AS INT) AS col_idx FROM nation) AS c""",
    "cells": """
        SELECT file_no, 0 AS row_idx, 0 AS col_idx, 'Comparable schedule ' || CAST(file_no AS STRING) AS value FROM (SELECT DISTINCT file_no FROM file_rows) AS t
        UNION ALL SELECT file_no, 1, col_idx, CASE WHEN layout = 4 AND col_idx = 3 THEN 'Base' ELSE header END FROM header_cells
        UNION ALL SELECT file_no, 2, col_idx, CASE WHEN col_idx = 3 THEN 'Rent Yearly' ELSE 'cont.' END FROM header_cells WHERE layout = 4
        UNION ALL SELECT r.file_no, CAST(3 + nth + CASE WHEN nth >= 7 THEN 1 ELSE 0 END AS INT), col_idx, CASE col_idx WHEN 0 THEN CAST(100 + c_custkey % 900 AS STRING) || ' Airport Road' WHEN 1 THEN c_name WHEN 2 THEN n || ' SF' WHEN 3 THEN '$' || n || '.00'
                 WHEN 4 THEN CAST(12 + c_custkey % 60 AS STRING) WHEN 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'TBD' ELSE CAST(c_custkey % 9 AS STRING) || '.5%' END
                 WHEN 6 THEN CAST(1 + c_custkey % 12 AS STRING) || '/' || CAST(1 + c_custkey % 28 AS STRING) || '/2021' ELSE 'ok' END
        FROM file_rows AS r CROSS JOIN (SELECT DISTINCT CAST(n_nationkey % 8 AS INT) AS col_idx FROM nation) AS c""",
}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _used(sql: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if re.search(rf"\b{n}\b", re.sub(r"'[^']*'", "", sql))]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"[{}]", lambda m: m[0] * 2, VIEWS[name])
    needs = {}
    for n in _used(sql):
        if n != name:
            needs[n] = view(spark, sf_dir, n)
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b(?! AS)", rf"\1 {{{n}}} AS {n}", sql)
            sql = re.sub(rf"\b(FROM|JOIN) {n} AS (?!{n}\b)", rf"\1 {{{n}}} AS ", sql)
    return spark.sql(sql, **needs)


@cache
def _order(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in (*_order(tuple(u for u in _used(VIEWS[n]) if u != n)), n) if x not in out]
    return tuple(out)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it uses in front, as common table expressions."""
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _order(tuple(u for u in _used(sql) if u in VIEWS)))
    if not views:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"
