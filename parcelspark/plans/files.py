"""Registered queries: ingest of spreadsheet cells, mapping, and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import clean_header, confidence_status, label
from ..operators import export, flow
from ..operators import ingest as g
from ..operators import mapping as m
from ..operators.matching import cosine
from ..sources.files import read_rows
from ..sources.scratch import folder, kept, spread
from ..sources.views import view, with_views
from ..streaming import arrivals
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


def _cells(spark, sf_dir):
    """Written once, as every step reads them and the given tables that they are multiplied from lie in one part or two."""
    return kept(spread(view(spark, sf_dir, "cells"), "file_no", "row_idx"), "cells")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOP = f"""t AS (SELECT file_no, row_idx, lower(string_agg(value, ' ' ORDER BY col_idx)) AS text FROM cells WHERE row_idx < 30 GROUP BY ALL),
    k AS (SELECT *, len(list_filter({_list(g.KEYWORDS)}, lambda w: contains(text, w))) AS score FROM t),
    top AS (SELECT file_no, CASE WHEN score >= 2 THEN row_idx ELSE 0 END AS header_row, score, score >= 2 AS found FROM k QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY score DESC, row_idx) = 1)"""
_HEADS = f"""{_TOP},
    wide AS (SELECT file_no, max(col_idx) + 1 AS width FROM cells GROUP BY 1),
    near AS (SELECT file_no, row_idx - header_row AS down, col_idx, trim(value) AS value, header_row, found FROM cells JOIN top USING (file_no) WHERE row_idx BETWEEN header_row AND header_row + 2),
    rt AS (SELECT file_no, down, string_agg(value, ' ' ORDER BY col_idx) AS text, count(*) FILTER (WHERE value <> '') AS filled FROM near GROUP BY ALL),
    jn AS (SELECT file_no, down, filled > width * 0.3 AND NOT (contains(text, '$') OR regexp_matches(text, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') OR length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.3) AS j FROM rt JOIN wide USING (file_no)),
    sb AS (SELECT file_no, CASE WHEN NOT found OR NOT coalesce(bool_or(j) FILTER (WHERE down = 1), false) THEN 0 WHEN coalesce(bool_or(j) FILTER (WHERE down = 2), false) THEN 2 ELSE 1 END AS subs, found, header_row FROM jn JOIN top USING (file_no) GROUP BY file_no, found, header_row),
    gr AS (SELECT file_no, subs, found, header_row, unnest(range(width)) AS col_idx FROM sb JOIN wide USING (file_no)),
    pt AS (SELECT file_no, col_idx, max(value) FILTER (WHERE down = 0) AS h0, max(value) FILTER (WHERE down = 1) AS h1, max(value) FILTER (WHERE down = 2) AS h2 FROM near GROUP BY ALL),
    nm AS (SELECT file_no, col_idx, found, header_row + 1 + subs AS data_row, CASE WHEN subs = 0 THEN coalesce(h0, 'Unnamed: ' || CAST(col_idx AS VARCHAR))
             ELSE coalesce(nullif(concat_ws(' ', nullif(h0, ''), CASE WHEN subs >= 1 THEN nullif(h1, '') END, CASE WHEN subs >= 2 THEN nullif(h2, '') END), ''), 'Unknown') END AS name FROM gr LEFT JOIN pt USING (file_no, col_idx)),
    heads AS (SELECT file_no, col_idx, data_row, name, CASE WHEN found AND nth > 1 THEN name || '_' || CAST(nth AS VARCHAR) ELSE name END AS header FROM (SELECT *, row_number() OVER (PARTITION BY file_no, name ORDER BY col_idx) AS nth FROM nm))"""
_DATA = f"""{_HEADS},
    dt AS (SELECT c.* FROM cells AS c JOIN (SELECT DISTINCT file_no, data_row FROM heads) AS h USING (file_no) WHERE row_idx >= data_row)"""
_PROFILE = _DATA + r""",
    sm AS (SELECT *, row_number() OVER (PARTITION BY file_no, col_idx ORDER BY row_idx) AS nth, trim(value) NOT IN ('', '-', '_', '--', 'N/A', 'n/a', 'nan', 'None') AS kept FROM dt QUALIFY nth <= 20),
    sq AS (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY file_no, col_idx ORDER BY row_idx) AS seq FROM sm),
    ct AS (SELECT file_no, col_idx, count(*) FILTER (WHERE kept) AS n, bool_or(kept AND contains(value, '$')) AS money,
             count(*) FILTER (WHERE kept AND (regexp_matches(trim(regexp_replace(value, '[$,%]', '', 'g')), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') OR regexp_matches(trim(value), '^[0-9,.]+\s*/\s*\w+'))) AS numbers,
             count(*) FILTER (WHERE kept AND seq <= 8 AND regexp_matches(value, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')) AS dates FROM sq GROUP BY ALL),
    profiles AS (SELECT file_no, col_idx, CASE WHEN n = 0 THEN 'empty' WHEN numbers / n > 0.5 AND money THEN 'numeric_money' WHEN numbers / n > 0.5 THEN 'numeric_clean' WHEN dates >= 2 THEN 'date' ELSE 'text' END AS profile FROM ct)"""
_CLASS = f"""{_HEADS},
    sc AS (SELECT file_no, count(*) FILTER (WHERE len(list_filter({_list(g.LEASE_TRIGGERS)}, lambda w: contains(lower(trim(header)), w))) > 0) AS lease_score,
                  count(*) FILTER (WHERE len(list_filter({_list(g.SALE_TRIGGERS)}, lambda w: contains(lower(trim(header)), w))) > 0) AS sale_score FROM heads GROUP BY 1),
    kinds AS (SELECT *, CASE WHEN lease_score > sale_score THEN 'LEASE' WHEN sale_score > lease_score THEN 'SALE' WHEN lease_score > 0 THEN 'BOTH' ELSE 'UNKNOWN' END AS kind FROM sc)"""
_ALIASES = "al(kind, alias, field) AS (VALUES " + ", ".join(f"('{k}', '{a}', '{f}')" for k in ("LEASE", "SALE", "BOTH", "UNKNOWN") for a, f in m.aliases(k) if f in m.fields(k)) + ")"
_CLEAN = r"trim(regexp_replace(regexp_replace(translate(lower(header), '_.', '  '), '[^a-z0-9_\s/]', '', 'g'), '\s+', ' ', 'g'))"
_LEVELS = f"""{_CLASS}, {_ALIASES}, hc AS (SELECT heads.file_no, heads.col_idx, kind, {_CLEAN} AS header FROM heads JOIN kinds USING (file_no)),
    lv AS (SELECT kind, header, field, max(CASE WHEN header = alias THEN 3000 WHEN length(alias) >= 3 AND contains(header, alias) THEN 2000 END + length(alias)) AS best FROM (SELECT DISTINCT kind, header FROM hc) JOIN al USING (kind)
           WHERE header = alias OR (length(alias) >= 3 AND contains(header, alias)) GROUP BY ALL)"""


def _heads(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    names = g.headers(cells)
    kinds = g.file_classes(names).select(g.FILE, "kind")
    data = g.data_cells(cells, names)
    return data, names.join(kinds, g.FILE).withColumn("header", clean_header(F.col("header"))).join(g.profiles(data), [g.FILE, "col_idx"], "left").withColumn("profile", F.coalesce("profile", F.lit("empty")))


@query(f"WITH {_TOP} SELECT file_no, header_row, score, found FROM top")
def header_detect(spark, sf_dir):
    return g.header_rows(_cells(spark, sf_dir))


@query(f"WITH {_HEADS} SELECT file_no, col_idx, name, data_row FROM heads")
def split_header_merge(spark, sf_dir):
    return g.headers(_cells(spark, sf_dir)).select("file_no", "col_idx", F.regexp_replace("header", r"^(Notes.*)_\d$", "$1").alias("name"), "data_row")


@query(f"WITH {_HEADS} SELECT file_no, col_idx, header FROM heads")
def header_dedup(spark, sf_dir):
    return g.headers(_cells(spark, sf_dir)).select("file_no", "col_idx", "header")


@query(f"WITH {_DATA}, f AS (SELECT file_no, row_idx FROM (SELECT DISTINCT file_no, row_idx FROM dt) QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY row_idx) <= 6) SELECT file_no, row_idx, col_idx, value FROM dt JOIN f USING (file_no, row_idx)")
def data_row_cap(spark, sf_dir):
    """At most six rows of each file."""
    cells = _cells(spark, sf_dir)
    return g.data_cells(cells, g.headers(cells), 6).select("file_no", "row_idx", "col_idx", "value")


@query("""SELECT id, address, notes || ' "' || city || E'"\\n' || zip_code AS remark, CAST(CAST(year_built AS INTEGER) AS VARCHAR) AS built FROM sale_comps""")
def csv_round_trip(spark, sf_dir):
    """All sales exported as CSV files and read again cell by cell: commas, quotes and line breaks in cells, and missing ones."""
    sales = view(spark, sf_dir, "sale_comps")
    remark = F.concat("notes", F.lit(' "'), "city", F.lit('"\n'), "zip_code")
    path = folder(spark, "csv-export")
    export.to_csv(sales.select("id", "address", remark.alias("remark"), F.col("year_built").cast("int").alias("built")), path)
    rows = read_rows(spark, path, ["id", "address", "remark", "built"]).where("row_idx > 0")
    return rows.select(F.col("id").cast("bigint").alias("id"), "address", "remark", "built")


@query(f"WITH {_PROFILE} SELECT * FROM profiles")
def column_profile(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return g.profiles(g.data_cells(cells, g.headers(cells)))


@query(f"WITH {_CLASS} SELECT * FROM kinds")
def file_classify(spark, sf_dir):
    return g.file_classes(g.headers(_cells(spark, sf_dir)))


@query(f"WITH {_LEVELS} SELECT kind, header, field, best // 1000 AS level, best % 1000 AS alias_length FROM lv")
def alias_match(spark, sf_dir):
    return m.alias_levels(_heads(spark, sf_dir)[1], fuzzy=False)


_TYPES = "ft(kind, field, type) AS (VALUES " + ", ".join(f"('{k}', '{f}', '{t}')" for k in ("LEASE", "SALE", "BOTH", "UNKNOWN") for f, t in m.fields(k).items()) + ")"


@query(f"""WITH {_LEVELS.replace(_CLASS, _PROFILE + "," + _CLASS[len(_HEADS):].lstrip().lstrip(","))}, {_TYPES}
    SELECT file_no, field, col_idx, CASE WHEN best IS NOT NULL THEN 100.0 WHEN type = coalesce(profile, 'empty') THEN 0.25 WHEN type IN ('numeric_money', 'numeric_clean') AND profile = 'text' THEN -0.20 WHEN type = 'date' THEN -0.30
        WHEN type = 'text' AND profile IN ('numeric_money', 'numeric_clean') THEN -0.15 ELSE 0.0 END AS score
    FROM hc JOIN ft USING (kind) LEFT JOIN lv USING (kind, header, field) LEFT JOIN profiles USING (file_no, col_idx)""")
def pair_scores(spark, sf_dir):
    heads = _heads(spark, sf_dir)[1]
    return m.pair_scores(heads, m.alias_levels(heads, fuzzy=False)).select("file_no", "field", "col_idx", "score")


@query()
def assign_exact(spark, sf_dir):
    heads = _heads(spark, sf_dir)[1]
    return m.exact_assignment(m.pair_scores(heads, m.alias_levels(heads)))


_PAIRS = f"""{_LEVELS.replace(_CLASS, _PROFILE + "," + _CLASS[len(_HEADS):].lstrip().lstrip(","))}, {_TYPES},
    ps AS (SELECT file_no, field, col_idx, CASE WHEN best IS NOT NULL THEN 100.0 WHEN type = coalesce(profile, 'empty') THEN 0.25 WHEN type IN ('numeric_money', 'numeric_clean') AND profile = 'text' THEN -0.20 WHEN type = 'date' THEN -0.30
            WHEN type = 'text' AND profile IN ('numeric_money', 'numeric_clean') THEN -0.15 ELSE 0.0 END AS score, coalesce(best // 1000, 0) AS level, coalesce(best % 1000, 0) AS alias_length, header, type, profile
        FROM hc JOIN ft USING (kind) LEFT JOIN lv USING (kind, header, field) LEFT JOIN profiles USING (file_no, col_idx))"""


def _mutual_sql(rounds: int = 8) -> str:
    order = "ORDER BY score DESC, level DESC, alias_length DESC, col_idx, field"
    parts = ["l0 AS (SELECT * FROM ps WHERE score >= 0.55)"]
    for k in range(rounds):
        parts += [f"b{k} AS (SELECT file_no, field, col_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY file_no, field {order}) AS f, row_number() OVER (PARTITION BY file_no, col_idx {order}) AS c FROM l{k}) AS t{k} WHERE f = 1 AND c = 1)",
                  f"l{k + 1} AS (SELECT * FROM l{k} WHERE (file_no, field) NOT IN (SELECT (file_no, field) FROM b{k}) AND (file_no, col_idx) NOT IN (SELECT (file_no, col_idx) FROM b{k}))"]
    return f"WITH {_PAIRS}, {', '.join(parts)} SELECT file_no, field, col_idx, round(least(score, 1.0), 3) AS confidence FROM ({' UNION ALL '.join(f'SELECT * FROM b{k}' for k in range(rounds))}) AS every"


@query(_mutual_sql())
def assign_mutual_best(spark, sf_dir):
    """Without the close spellings, which SQL cannot express; those take part in ``assign_exact``."""
    heads = _heads(spark, sf_dir)[1]
    return m.mutual_best(m.pair_scores(heads, m.alias_levels(heads, fuzzy=False)))


_DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_COSINE = f"greatest(0.0, coalesce({_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 0), 0))"


@query(f"""WITH {_PAIRS}, sz AS (SELECT count(*) AS size FROM embeddings)
    SELECT file_no, field, col_idx, round(CASE WHEN level > 0 THEN 100.0 ELSE score + {_COSINE} END, 6) AS score
    FROM ps CROSS JOIN sz JOIN embeddings AS a ON a.vec_id = (length(header) * 31) % size JOIN embeddings AS b ON b.vec_id = (length(field) * 17) % size""")
def pair_scores_semantic(spark, sf_dir):
    """Headers and fields with vectors of their own, taken from the given ones by the lengths of their names."""
    heads = _heads(spark, sf_dir)[1]
    vectors = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.count()
    of = lambda rows, name, step: rows.select(name).distinct().withColumn("vec_id", (F.length(name) * step).cast("bigint") % size).join(vectors, "vec_id")
    header = of(heads, "header", 31).select("header", F.col("embedding").alias("header_vector"))
    names = spark.createDataFrame([(f,) for f in {**m.LEASE_FIELDS, **m.SALE_FIELDS}], "field string")
    field = of(names, "field", 17).select("field", F.col("embedding").alias("field_vector"))
    return m.pair_scores(heads, m.alias_levels(heads, fuzzy=False), header, field).select("file_no", "field", "col_idx", F.round("score", 6).alias("score"))


@query(f"WITH {_PAIRS} SELECT DISTINCT field, array_to_string(list_transform(string_split(replace(field, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label, CASE WHEN score >= 1.0 THEN 'Override' WHEN score >= 0.60 THEN 'High' WHEN score >= 0.45 THEN 'Medium' ELSE 'Not Mapped' END AS status FROM ps")
def field_labels(spark, sf_dir):
    heads = _heads(spark, sf_dir)[1]
    scores = m.pair_scores(heads, m.alias_levels(heads, fuzzy=False))
    return scores.select("field", label(F.col("field")).alias("label"), confidence_status(F.col("score")).alias("status")).distinct()


@query(f"""WITH {_HEADS}, hv AS (SELECT file_no, col_idx, {_CLEAN} AS header, (file_no * 8 + col_idx) % (SELECT count(*) FROM embeddings) AS vec_id FROM heads),
    sm AS (SELECT file_no, col_idx, header, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s
           FROM hv JOIN embeddings AS a USING (vec_id), embeddings AS b WHERE b.vec_id = 0)
    SELECT file_no, col_idx, row_number() OVER (PARTITION BY file_no ORDER BY s DESC, col_idx) AS nth FROM sm WHERE s > 0.55 AND NOT regexp_matches(header, 'state|city|zip|postal|county|country|submarket') QUALIFY nth <= 3""")
def address_candidates(spark, sf_dir):
    vectors = view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.count("*").alias("size"))
    heads = g.headers(_cells(spark, sf_dir)).withColumn("header", clean_header(F.col("header"))).crossJoin(F.broadcast(size)).withColumn("vec_id", (F.col("file_no") * 8 + F.col("col_idx")) % F.col("size"))
    target = vectors.where("vec_id = 0").select(F.col("embedding").alias("target"))
    rows = heads.join(vectors, "vec_id").crossJoin(F.broadcast(target))  # one row each
    return m.address_candidates(rows, cosine(F.col("embedding"), F.col("target")))


def _places(spark, sf_dir):
    """A gazetteer of the street addresses in the cells: the first sale of each house number."""
    sales = view(spark, sf_dir, "sale_comps").withColumn("number", 100 + F.col("id") % 900)
    one = sales.groupBy("number").agg(F.min(F.struct("id", "latitude", "longitude", "city", "zip_code")).alias("p"))
    return one.select(F.concat(F.col("number").cast("string"), F.lit(" Airport Road, TX")).alias("address"), "p.latitude", "p.longitude", "p.city", "p.zip_code")


@query()
def ingest_end_to_end(spark, sf_dir):
    """Sales of all files as they are stored; addresses that the store has from every fiftieth customer are not saved again."""
    stored = view(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"), F.concat((100 + F.col("c_custkey") % 900).cast("string"), F.lit(" Airport Road, TX")).alias("address"))
    return flow.ingested(_cells(spark, sf_dir), _places(spark, sf_dir), stored)["SALE"].drop("created_at")


@query()
def ingest_leases(spark, sf_dir):
    """Leases of all files, with monthly and annual rates."""
    return flow.ingested(_cells(spark, sf_dir), _places(spark, sf_dir), None)["LEASE"].drop("created_at")


@query(f"""WITH a AS (SELECT o_orderkey, CAST(100 + o_custkey % 900 AS VARCHAR) || ' Airport Road, Houston, TX ' || CAST(77000 + o_custkey % 40 AS VARCHAR) AS address FROM orders)
    SELECT min(o_orderkey) AS new_id, {NORMAL.format(c='address')} AS normalized FROM a GROUP BY 2""")
def stream_ingest_dedupe(spark, sf_dir):
    """Orders arrive as listings, file by file; of equal addresses one is stored, of those in one file the least order. The given table is one file."""
    schema = view(spark, sf_dir, "orders").schema
    address = ["o_orderkey AS new_id", "concat(100 + o_custkey % 900, ' Airport Road, Houston, TX ', 77000 + o_custkey % 40) AS address"]
    stored, checkpoint = folder(spark, "stream-store"), folder(spark, "stream-checkpoint")
    # a pattern, as a stream's plain path must be a folder, and the table may be one file
    return arrivals.run_arrivals(spark, f"{sf_dir}/orders.parque[t]", schema, stored, checkpoint, address)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_hourly_events(spark, sf_dir):
    """Events per hour and type as a stream with a watermark of a day: hours that no late event can reach any more."""
    schema = view(spark, sf_dir, "events").select("ts", "event_type", "value").schema
    found = arrivals.hourly_events(spark, f"{sf_dir}/events.parque[t]", schema, folder(spark, "hourly-events"), folder(spark, "stream-checkpoint"))
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
