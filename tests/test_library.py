"""Edge tables, properties and brute-force versions of the property operators."""

import csv
import itertools
import random
import shutil
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import clean, geo
from parcelspark.operators import duplicates, flow, ingest, mapping, matching, radius, rates, stats, store
from parcelspark.operators.filters import Filter, filtered, page, page_after
from parcelspark.sources import files
from parcelspark.sources.files import MISSING, read_cells
from parcelspark.sources.views import view
from parcelspark.streaming import arrivals


def column(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_to_float(spark):
    cases = {"$3,217,500.00 ": 3217500.0, " $ -   ": None, "4.00%": 4.0, "6.7% CAP": 6.7, "-5%": 5.0, "$5,900/acre Gross": 5900.0, "7/14/2024": 7.0, "Building 4 at Park": None, "1e5": 100000.0, "inf": None,
             "$  8.15": 8.15, "N/A": None, "TBD": None, "": None, "12,000 SF": 12000.0, "1d": 1.0, "..%": None}
    assert column(spark, clean.to_float, list(cases)) == list(cases.values())


def test_text_functions(spark):
    assert column(spark, clean.clean_header, ["Price_per\nS.F.", " Año  built? ", "a/b"]) == ["price per s f", "año built", "a/b"]
    assert column(spark, clean.normalize_address, ["12 North Main Street, Suite 4.", None, ""]) == ["12 n main st ste 4", "", ""]
    assert column(spark, clean.extract_zip, ["12345 Oak, TX 77001", "1 Oak", None]) == ["12345", None, None]
    assert column(spark, lambda c: clean.extract_zip(c, last=True), ["12345 Oak, TX 77001"]) == ["77001"]
    assert column(spark, clean.extract_city, ["1 Oak, Katy, TX 77001", "1 Oak, katy, texas", "Katy TX"]) == ["Katy", "katy", None]
    assert column(spark, clean.append_state, ["1 Oak", "1 Oak, TX", "1 Oak txyz"]) == ["1 Oak, TX", "1 Oak, TX", "1 Oak txyz"]
    assert column(spark, clean.simplify_address, ["1 Oak Suite #12 Katy", "1 Oak fl 2"]) == ["1 Oak Katy", "1 Oak"]
    assert column(spark, clean.currency, ["$1,200 sf", "about 12", None]) == [1200.0, None, None]
    assert [str(d) if d else None for d in column(spark, clean.parse_date, ["2020-01-31", "1/2/2021", "May-25", "Jan 3, 2020", "soon", None])] == ["2020-01-31", "2021-01-02", "2025-05-01", "2020-01-03", None, None]


def test_distances_and_scores(spark):
    points = [(29.7, -95.3), (29.9, -95.6), (31.0, -97.0)]
    rows = spark.createDataFrame([(*a, *b) for a in points for b in points], "a double, b double, c double, d double")
    got = rows.select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), geo.haversine(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-9 for r in got) and sum(r.x < 1e-9 for r in got) == 3
    s = spark.createDataFrame([(10.0, 10.0), (10.0, 5.0), (0.0, 0.0), (10.0, None), (None, 1.0), (0.0, None)], "s double, c double")
    assert [r[0] for r in s.select(matching.numeric(F.col("s"), F.col("c"))).collect()] == [1.0, 0.0, 1.0, None, None, None]
    assert [r[0] for r in s.select(matching.numeric(F.col("s"), F.col("c"), 0.5, F.lit(True))).collect()] == [1.0, 0.0, 1.0, 0.0, None, 1.0]
    w = spark.createDataFrame([(1.0, None), (None, None), (0.5, 1.0)], "a double, b double")
    assert [r[0] for r in w.select(matching.weighted({"a": F.col("a"), "b": F.col("b")}, {"a": 0.3, "b": 0.1})).collect()] == [1.0, 0.0, pytest.approx(0.625)]


def test_radius_join_is_brute_force(spark):
    r = random.Random(1)
    comps = spark.createDataFrame([(i, 29 + r.random(), -96 + r.random()) for i in range(300)], "id long, latitude double, longitude double")
    subjects = spark.createDataFrame([(i, 29 + r.random(), -96 + r.random()) for i in range(12)], "subject_id long, latitude double, longitude double")
    got = {(x.subject_id, x.id) for x in radius.radius_join(comps, subjects, 7.0).collect()}
    plain = comps.crossJoin(subjects.withColumnsRenamed({"latitude": "a", "longitude": "b"})).where(geo.haversine(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude")) <= 7.0)
    assert got == {(x.subject_id, x.id) for x in plain.collect()} and got


def test_radius_join_with_crowds(spark):
    """Half of all records in one block, some at one point: the parts stay even and the pairs are those of the plain join."""
    r = random.Random(4)
    block = [(i, 29.76 + r.random() * 0.002, -95.37 + r.random() * 0.002) for i in range(2_000)] + [(i + 2_000, 29.7612, -95.3688) for i in range(2_000)]
    rows = block + [(i + 4_000, 29 + r.random() * 1.5, -96 + r.random() * 1.3) for i in range(4_000)]
    comps = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    subjects = spark.createDataFrame([(i, 29.5 + r.random() * 0.5, -95.7 + r.random() * 0.6) for i in range(8)] + [(8, 29.761, -95.369), (9, None, None)], "subject_id long, latitude double, longitude double")
    records, crowded, full = radius.placed(comps, 3.0, 100)
    sizes = [x["count"] for x in records.groupBy("y", "x", "v", "u", "salt").count().collect()]
    assert crowded.count() >= 1 and full.count() >= 1 and sum(sizes) == 8_000 and max(sizes) <= 180 and sum(s > 300 for s in sizes) == 0
    got = sorted((x.subject_id, x.id, round(x.distance_miles, 6)) for x in radius.radius_join(comps, subjects, 3.0, 100).collect())
    plain = comps.crossJoin(subjects.withColumnsRenamed({"latitude": "a", "longitude": "b"})).withColumn("m", geo.haversine(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))).where("m <= 3.0")
    assert got == sorted((x.subject_id, x.id, round(x.m, 6)) for x in plain.collect()) and len(got) > 4_000


def test_addresses_between_known_numbers(spark):
    places = spark.createDataFrame([(f"{n} Oak Street, Katy, TX 77001", 29.0 + n / 1000, -95.0 - n / 1000, f"city {n}", str(n)) for n in (100, 110, 390, 1_000, 1_450)] + [("9 Elm Road, TX", None, None, None, None), ("Oak", 1.0, 1.0, None, None)],
                                   "address string, latitude double, longitude double, city string, zip_code string")
    asked = {1: "104 OAK ST., Katy, TX 77001", 2: "110 Oak Street, Katy, TX 77001", 3: "250 Oak Street, Katy, TX 77001", 4: "99 Oak Street, Katy, TX 77001", 5: "1100 Oak Street, Katy, TX 77001", 6: "Oak Street", 7: "8 Elm Road", 8: None, 9: "104 Oak Street, Katy, TX 77001", 10: "106 Oak Street, Katy, TX 77001"}
    got = {r.id: (r.matched, r.latitude and round(r.latitude, 6), r.city) for r in store.geocoded_between(spark.createDataFrame(list(asked.items()), "id long, address string"), places).collect()}
    assert got == {1: ("interpolated", 29.104, "city 100"), 2: ("full", 29.11, "city 110"), 3: ("interpolated", 29.25, "city 110"), 4: ("none", None, None), 5: ("none", None, None), 6: ("none", None, None), 7: ("none", None, None),
                   8: ("none", None, None), 9: ("interpolated", 29.104, "city 100"), 10: ("interpolated", 29.106, "city 110")}


def test_nearest_vectors_by_rings(spark):
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 25]]) for i in range(3_000)] + [(i + 3_000, [0.5] * 16) for i in range(40)] + [(9_000, None), (9_001, [0.0] * 16), (9_002, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("subject_id"), F.col("vector").alias("query"))
    counted = []
    got = sorted(tuple(x) for x in matching.nearest(vectors, asked, 4, counted=counted).collect())
    x = np.array([v for _, v in rows[:3_040]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = []
    for i in range(0, 3_040, 20):
        score = np.round(x @ x[i], 5)
        score[i] = -1
        want += [(i, n + 1, int(j), score[j]) for n, j in enumerate(np.lexsort((np.arange(len(x)), -score))[:4]) if score[j] > 0]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-5 for g, w in zip(got, sorted(want)))
    assert sum(counted) < 0.3 * len(x) * len(x) / 20


def test_nearest_vectors_make_no_row_for_a_pair(spark, monkeypatch):
    """Vectors without structure and many copies: scores written are some for each query and part of a ring, and a ring of several parts gives the same."""
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(1_500)]
    rows += [(i, rows[7][1]) for i in range(1_500, 2_000)] + [(2_000, [1.0] * 3), (2_001, [float("inf")] * 24)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = vectors.where("id % 20 = 7").select(F.col("id").alias("subject_id"), F.col("vector").alias("query"))
    made, plain = {}, matching.kept

    def counted(df, name):
        made[name] = plain(df, name)
        return made[name]

    monkeypatch.setattr(matching, "kept", counted)
    x = np.array([v for _, v in rows[:2_000]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = []
    for i in range(7, 2_000, 20):
        score = np.round(x @ x[i], 5)
        score[i] = -1
        want += [(i, n + 1, int(j)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -score))[:4])]
    for tile in (32_768, 50):
        monkeypatch.setattr(matching, "TILE", tile)
        got = matching.nearest(vectors, asked, 4).orderBy("subject_id", "rank").collect()
        assert [tuple(g)[:3] for g in got] == want
        cells = made["first-cells"].select(F.sum(F.ceil(F.col("n") / tile))).first()[0]
        assert made["first-scores"].count() <= 4 * cells


def test_fuzzy_joins_are_brute_force(spark):
    r = random.Random(2)
    streets = ["Airport Road", "Eastex Highway", "North Main Street", "Oak"]
    stored = [(i, f"{r.randint(1, 40)} {r.choice(streets)}, Katy") for i in range(80)] + [(900, None), (901, "!")]
    new = [(i, "".join(c for c in a.upper() if r.random() > 0.05)) for i, a in stored[:30]] + [(77, None)]
    s, n = spark.createDataFrame(stored, "id long, address string"), spark.createDataFrame(new, "new_id long, address string")
    norm = lambda rows: {i: a for i, a in zip([x[0] for x in rows], column(spark, clean.normalize_address, [x[1] for x in rows])) if a}
    a, b = norm(new), norm(stored)
    want = {(i, j) for i, x in a.items() for j, y in b.items() if SequenceMatcher(None, x, y).ratio() >= 0.85}
    assert {(x.new_id, x.existing_id) for x in duplicates.by_ratio(n, s).collect()} == want and want

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    want = {(i, j) for i, x in a.items() for j, y in b.items() if 1 - lev(x, y) / max(len(x), len(y)) >= 0.85}
    assert {(x.new_id, x.existing_id) for x in duplicates.by_levenshtein(n, s).collect()} == want


def test_ratio_join_is_whole(spark):
    import __spark_entry__ as e

    sf_dir = "/root/testdata/sf0.001"
    new, stored = view(spark, sf_dir, "listing_batch").limit(6).select("new_id", "address"), view(spark, sf_dir, "sale_comps").select("id", "address")
    norm = lambda df: df.withColumn("address", clean.normalize_address(F.col("address"))).collect()
    a, b = norm(new), norm(stored)
    want = {(x.new_id, y.id) for x in a for y in b if SequenceMatcher(None, x.address, y.address).ratio() >= 0.85}
    some = {x.new_id for x in a}
    got = {(r.new_id, r.existing_id) for r in e.queries()["dup_ratio_join"](spark, sf_dir).collect() if r.new_id in some}
    assert got == want and want


def streets(r, n):
    """Addresses of many streets, and some that differ from an earlier one by a few letters."""
    syllables = ["ar", "bel", "cor", "den", "el", "fair", "glen", "hol", "in", "ken", "lan", "mor", "nor", "oak", "pine", "quail", "rose", "sun", "tal", "wood"]
    out = []
    for _ in range(n):
        if out and r.random() < 0.3:
            a = list(r.choice(out))
            for _ in range(r.randint(0, 6)):
                i = r.randrange(len(a))
                a[i: i + r.randint(0, 1)] = r.choice(["", "x", " ", "7"])
            out.append("".join(a))
        else:
            out.append(f"{r.randint(1, 9999)} {''.join(r.choices(syllables, k=r.randint(2, 3)))} {r.choice(['Street', 'Road', 'Lane', 'Drive'])}, {''.join(r.choices(syllables, k=2))}, TX {r.randint(73000, 79999)}")
    return out


def test_ratio_candidates_are_few_and_best_matches_rise(spark):
    r = random.Random(9)
    every = streets(r, 700)
    stored = list(enumerate(every)) + [(1_000 + i, a) for i, a in enumerate(every[::7])] + [(3_000, "z" * 230), (3_001, "the " * 60)]
    new = [(i, a) for i, a in enumerate(r.sample(every, 60) + streets(r, 60) + ["", None, "!", "q", "z" * 229, "the " * 59 + "end"])]
    s, n = spark.createDataFrame(stored, "id long, address string"), spark.createDataFrame(new, "new_id long, address string")
    norm = lambda rows: {i: a for i, a in zip([x[0] for x in rows], column(spark, clean.normalize_address, [x[1] for x in rows])) if a}
    a, b = norm(new), norm(stored)
    pairs = {}
    for x in set(a.values()):
        for y in set(b.values()):
            m = SequenceMatcher(None, x, y)
            if m.quick_ratio() >= 0.85 and m.ratio() >= 0.85:
                pairs[x, y] = m.ratio()
    want = {(i, j): pairs[x, y] for i, x in a.items() for j, y in b.items() if (x, y) in pairs}
    assert {(x.new_id, x.existing_id): x.score for x in duplicates.by_ratio(n, s).collect()} == want
    top = {}
    for (i, j), score in want.items():
        top[i] = min(top.get(i, (0, 0)), (-score, j))
    assert {x.new_id: (-x.score, x.existing_id) for x in duplicates.best(n, s).collect()} == top and len(top) > 60
    assert {x.new_id for x in duplicates.without_duplicates(n, duplicates.best(n, s)).collect()} == {i for i, _ in new} - set(top)
    fresh, held = (spark.createDataFrame([(x,) for x in set(d.values())], f"{c} string") for d, c in ((a, "a"), (b, "b")))
    met = duplicates._may_match(fresh, held, 0.85).count()
    assert met < 0.05 * fresh.count() * held.count()
    risen = duplicates.best_of(fresh, held.withColumn("first_id", F.lit(1).cast("bigint"))).agg(F.sum("tried")).first()[0]
    assert risen < met


def test_spaces_of_addresses(spark):
    odd = ["123\u00a0Main Street", "\t5 Oak Road\n", " \u2003 ", "! x", "9\u2009 Elm\u3000\u3000Lane \x1f", "5 R\u00fce Road", "Cafe\u0301 Street", "\u0661 North-East"]
    assert column(spark, clean.normalize_address, odd) == ["123 main st", "5 oak rd", "", " x", "9 elm ln", "5 r\u00fce rd", "cafe st", "\u0661 northeast"]


def test_top_matches_are_those_of_all_pairs(spark):
    r = random.Random(12)
    some = lambda x: None if r.random() < 0.15 else x
    rows = [(i, some(29 + r.random() * 1.5), -96 + r.random() * 1.3, some(r.lognormvariate(9, 1)), some(r.lognormvariate(12, 1)), some(r.random() * 90), some(float(r.randint(1960, 2024))), some(f"{r.randint(1995, 2003)}-0{r.randint(1, 9)}-11")) for i in range(5_000)]
    rows += [(i + 5_000, *rows[i % 3][1:]) for i in range(200)]  # ties
    comps = spark.createDataFrame(rows, "id long, latitude double, longitude double, building_size double, sale_price double, price_per_sf double, year_built double, closing_date string").withColumn("closing_date", F.col("closing_date").cast("date"))
    asked = spark.createDataFrame([(i, 29 + r.random() * 1.5, -96 + r.random() * 1.3, some(r.lognormvariate(9, 1)), some(r.lognormvariate(12, 1)), some(40.0), some(2000.0)) for i in range(12)] + [(99, rows[0][1] or 29.5, *rows[0][2:7]), (100, 60.0, 10.0, None, None, None, None)],
                                  "subject_id long, latitude double, longitude double, building_size double, sale_price double, price_per_sf double, year_built double")
    day = F.lit("2002-01-01").cast("date")
    dims, counted = matching.sale_dimensions(day), []
    got = [tuple(x) for x in matching.top_matches(comps, asked, dims, matching.sale_bounds(day), matching.WEIGHTS, matching.sale_cells(), 5, counted=counted).collect()]
    plain = matching.scored(comps, asked, dims, matching.WEIGHTS).withColumn("match_score", F.round("match_score", 6))
    want = [tuple(x) for x in matching.ranked(plain, 5).select("subject_id", "rank", "id", "match_score").collect()]
    assert sorted(got) == sorted(want) and len(got) >= 65
    assert counted[0] < 0.2 * 5_200 * 14
    with pytest.raises(ValueError):
        matching.top_matches(comps, asked, dims | {"own": lambda s, c: c("id")}, matching.sale_bounds(day), matching.WEIGHTS | {"own": 1.0}, matching.sale_cells(), 5)
    own = dims | {"own": lambda s, c: F.when(c("id") % 2 == 0, 1.0).otherwise(0.0)}  # a dimension of the caller's, over all pairs
    best = matching.ranked(matching.scored(comps, asked, own, {"own": 1.0}), 3).collect()
    assert all(x.id % 2 == 0 for x in best) and len(best) == 14 * 3


def test_assignment_is_brute_force():
    rng = np.random.default_rng(4)
    for rows, cols in [(1, 1), (3, 3), (2, 5), (5, 2), (5, 5)]:
        for _ in range(10):
            gain = rng.random((rows, cols))
            got = mapping.assigned(gain)
            size = max(rows, cols)
            full = np.zeros((size, size))
            full[:rows, :cols] = gain
            best = max(sum(full[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
            assert sum(gain[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)
            assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)


def test_rates_and_upper_median(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (1, 0.9, None), (1, 12.0, None), (2, 8.0, "x"), (2, 9.0, "Rent /mo"), (3, -1.0, None), (3, None, None), (4, 5.0, "Yearly")], "f int, rate_psf double, rate_header string")
    got = {(r.f, r.rate_psf): (r.rate_monthly, r.rate_annually, r.rate_basis) for r in rates.with_rates(rows, "f").collect()}
    assert got[(1, 12.0)] == (12.0, 144.0, "monthly_from_header") and got[(2, 8.0)] == (0.67, 8.0, "annual_from_header")
    assert got[(2, 9.0)] == (9.0, 108.0, "monthly_from_header") and got[(3, -1.0)] == (-1.0, -12.0, "monthly_inferred") and got[(3, None)] == (None, None, None)


def test_stats_edges(spark):
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [(r.bin, r.n) for r in stats.histogram(same, "x", 4).orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0)]
    line = spark.createDataFrame([(str(f"2020-01-{d:02d}"), 3.0 * d) for d in range(1, 29)], "d string, y double").withColumn("d", F.col("d").cast("date"))
    for r in stats.loess(line, "d", "y", 5).collect():
        assert r.fitted == pytest.approx(3.0 * (r.day - 18262 + 1), abs=1e-2)


def lowess(x, y, share=2 / 3, rounds=3):
    """Row by row, with neighbourhoods slid along the sorted rows; a day that one cuts counts by the part inside."""
    order = np.argsort(x, kind="stable")
    x, y = np.array(x, float)[order], np.array(y, float)[order]
    n, k, r, fit = len(x), max(1, int(share * len(x) + 1e-10)), np.ones(len(x)), {}
    for step in range(rounds + 1):
        left = 0
        for d in sorted(set(x)):
            while left + k < n and 2 * d > x[left] + x[left + k]:
                left += 1
            h = max(d - x[left], x[left + k - 1] - d)
            inside = np.zeros(n)
            inside[left: left + k] = 1
            for e in set(x):
                inside[x == e] = inside[x == e].mean()
            w = inside * r * (np.clip(1 - (np.abs(x - d) / h) ** 3, 0, None) ** 3 if h else 1)
            s0, mean = w.sum(), (w * x).sum() / w.sum()
            spread = (w * (x - mean) ** 2).sum() / s0
            fit[d] = (w * y).sum() / s0 if spread <= 1e-9 else (w * y * (1 + (d - mean) * (x - mean) / spread)).sum() / s0
        off = np.abs(y - np.array([fit[d] for d in x]))
        m = np.sort(off)[(n + 1) // 2 - 1]
        part = off / (6 * m) if m else (off > 0).astype(float)
        r = np.where(part >= 0.999, 0, np.where(part <= 0.001, 1, (1 - np.minimum(part, 1) ** 2) ** 2))
    return fit


def test_robust_local_regression(spark):
    r = random.Random(3)
    for rows in ([(18_000 + r.randint(0, 60), 0.0) for _ in range(150)], [(18_000, 1.0)] * 3, [(18_000, 1.0), (18_003, 5.0)]):
        rows = [(d, y or 3 + d / 50 + r.gauss(0, 0.2) + (40 if r.random() < 0.05 else 0)) for d, y in rows]
        df = spark.createDataFrame(rows + [(None, 1.0), (18_001, None)], "d int, y double").withColumn("d", F.date_from_unix_date("d"))
        got = {x.day: x.fitted for x in stats.lowess(df, "d", "y").collect()}
        want = lowess([d for d, _ in rows], [y for _, y in rows])
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)
    assert stats.lowess(df.where("false"), "d", "y").count() == 0


def test_lower_median_of_counted_values(spark):
    rng = random.Random(15)
    for rows in ([(0.0, 3), (5.0, 2)], [(1.0, 1), (2.0, 1)], [(rng.choice([0.0, 1e-300, rng.random(), 7.25, 1e200]), rng.randint(1, 9)) for _ in range(300)]):
        every = sorted(v for v, n in rows for _ in range(n))
        df = spark.createDataFrame(rows, "v double, n long")
        assert stats.lower_median(df, "v", "n").first()[0] == every[(len(every) - 1) // 2]
    assert stats.lower_median(df.where("false"), "v", "n").first()[0] is None


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 5), "a+b" if i % 2 else None) for i in range(23)], "id int, v double, t string")
    assert {r.id for r in filtered(df, [Filter("v", "range", 1, 2), Filter("t", "literal", "A+B"), Filter("gone", "range", 1)]).collect()} == {i for i in range(23) if i % 4 and 1 <= i % 5 <= 2 and i % 2}
    whole = [r.id for r in df.orderBy(F.col("v").asc_nulls_last(), "id").collect()]
    assert [r.id for r in page(df, "v", 2, size=5).collect()] == whole[5:10] and [r.id for r in page(df, "v", 99, size=5).collect()] == whole[20:]
    last = df.where(F.col("id") == whole[9]).first()
    assert [r.id for r in page_after(df, "v", last.v, last.id, size=5).collect()] == whole[10:15]


def test_sort_has_all_rows(spark):
    import __spark_entry__ as e

    sf_dir = "/root/testdata/sf0.1"
    rows = e.queries()["sort_nulls_last"](spark, sf_dir).collect()
    want = sorted(((r.year_built, r.id) for r in view(spark, sf_dir, "sale_comps").select("id", "year_built").collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(r.year_built, r.id) for r in sorted(rows, key=lambda r: r.nth)] == want and sorted(r.nth for r in rows) == list(range(1, len(want) + 1)) and len(want) > 15_000


def test_ingest_of_files(spark, tmp_path):
    (tmp_path / "Lease comps.csv").write_bytes('\r\n,links,,\r\n,Property Address,Tenant,Base,Leased SF\r\n,,,Rent Yearly,\r\n,"1 Sample St\nUnit 2",Tenant One,"$ 8.15 ","10,000"\r\n,,,,\r\n,2 Sample St,Tenant Two, $ -   ,Shell'.encode())
    (tmp_path / "plain.csv").write_text("x,y,x\n1,2,3\n")
    cells = read_cells(spark, str(tmp_path))
    heads = {(r.file_no[-9:], r.col_idx): r.header for r in ingest.headers(cells).collect()}
    assert heads[("plain.csv", 0)] == "x" and heads[("plain.csv", 2)] == "x"
    names = ingest.headers(cells).where(F.col("file_no").contains("Lease"))
    assert [r.header for r in names.orderBy("col_idx").collect()][1:] == ["Property Address", "Tenant", "Base", "Leased SF"]  # one cell of five is no sub-header
    kinds = {r.file_no[-9:]: r.kind for r in ingest.file_classes(ingest.headers(cells)).collect()}
    assert kinds["comps.csv".rjust(9)[-9:]] == "LEASE" and kinds["plain.csv"] == "UNKNOWN"


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), store.SALE)
    assert s.read().count() == 0
    s.append(spark.createDataFrame([(1, "a", 5.0), (2, "b", None)], "id long, address string, sale_price double"))
    s.update(spark.createDataFrame([(1, None)], "id long, sale_price double"), ["sale_price"])
    s.delete(spark.createDataFrame([(2,)], "id long"))
    assert [(r.id, r.sale_price) for r in s.read().collect()] == [(1, None)]
    s.clear()
    assert s.read().count() == 0


def test_queries_have_names_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_csv_files_to_stored_records(spark, tmp_path):
    """Two files from cells to the two schemas: joined addresses, rate units, price per sf, coordinates, duplicates; a file of no kind is left out."""
    (tmp_path / "sales.csv").write_text("Sale comps,,,,\nProperty Address,Property Name,Buyer,Sale Price,Size SF\n1 Oak Street,Tower,Ann,\"$1,000,000.00\",\"10,000 SF\"\n2 Oak Street,,Bob,\"$500,000.00\",\"4,000 SF\"\n1 OAK ST.,Tower,Cid,\"$7.00\",1\n9 Elm Road,,Dan,N/A,5\n")
    (tmp_path / "leases.csv").write_text("Address,Tenant,Leased SF,Base Rent Monthly,Lease Term\n3 Oak Street,Eve,1000,1.25,36\n2 Oak Street,Fay,2000,2.5,TBD\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    places = spark.createDataFrame([(f"{i} Oak Street, TX", 29.0 + i / 10, -95.0, "Katy", "77001") for i in (1, 2, 3)], "address string, latitude double, longitude double, city string, zip_code string")
    stored = spark.createDataFrame([(1, "2 Oak St, TX")], "id long, address string")
    found = flow.ingested(read_cells(spark, str(tmp_path)), places, stored)
    sales = sorted((r.raw_address_data, r.address, r.sale_price, r.building_size, r.price_per_sf, r.latitude, r.city) for r in found["SALE"].collect())
    assert len(sales) == 2 and {r[1] for r in sales} == {"1 Oak Street, TX", "9 Elm Road"}  # the copy of 1 Oak and the stored 2 Oak are not saved
    by_address = {r[1]: r for r in sales}
    assert by_address["9 Elm Road"][2:] == (None, 5.0, None, None, None)
    assert by_address["1 Oak Street, TX"][5:] == (pytest.approx(29.1), "Katy") and by_address["1 Oak Street, TX"][0] == "Tower 1 Oak Street" and by_address["1 Oak Street, TX"][2:5] == (1000000.0, 10000.0, 100.0)
    leases = [(r.address, r.tenant_name, r.rate_monthly, r.rate_annually, r.term_months) for r in found["LEASE"].collect()]
    assert leases == [("3 Oak Street, TX", "Eve", 1.25, 15.0, 36.0)]
    assert found["SALE"].columns == store.SALE.names and found["LEASE"].columns == store.LEASE.names


@pytest.mark.parametrize("size", [40, 64, 97, 1 << 20])
def test_large_files_are_cut_anywhere(spark, tmp_path, size):
    """Files read in byte ranges of every kind of length give the cells of a csv reader, whatever lies at the cuts."""
    r = random.Random(size)
    texts = ["a", "", "12", "x y", "two\nlines", "\n", "a,b", 'say ""hi""', '"', "five\" pipe", "three\n\nlines, and\nmore", "\r\n", "é" * 9, ",", '""', "end\n"]

    def cell(t):
        return f'"{t.replace(chr(34), chr(34) * 2)}"' if any(c in t for c in ',\n\r') or t.startswith('"') or r.random() < 0.2 else t

    for k in range(4):
        rows = [[r.choice(texts) for _ in range(r.randint(1, 6))] for _ in range(60)]
        end = "\r\n" if k % 2 else "\n"
        body = "".join(("" if r.random() < 0.1 else ",".join(map(cell, row))) + end for row in rows)
        if k == 3:
            body = body.rstrip("\r\n") + ',"never closed, and\nso on'
        (tmp_path / f"f{k}.csv").write_text(body, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {(r.file_no[-6:], r.row_idx, r.col_idx): r.value for r in read_cells(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for k in range(4):
        with open(tmp_path / f"f{k}.csv", newline="", encoding="utf-8") as f:
            rows = [row for row in csv.reader(f) if row]
        want |= {(f"f{k}.csv", i, j): v for i, row in enumerate(rows) for j, v in enumerate(row) if v not in MISSING}
    assert got == want and len(want) > 300


def test_lines_are_read_in_short_ranges(spark, tmp_path, monkeypatch):
    """Quoted cells over the ends of ranges of two lines; and rows are what their cells are."""
    rows = [[f"a{i}", "x\n" * (i % 5) + f'"{i}",', "" if i % 3 else "z"] for i in range(40)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    monkeypatch.setattr(files, "LINES", 1)
    got = files.read_rows(spark, str(tmp_path), ["a", "b", "c"]).orderBy("row_idx").collect()
    assert [[r.a, r.b, r.c or ""] for r in got] == rows and [r.row_idx for r in got] == list(range(40))
    cells = {(r.row_idx, r.col_idx): r.value for r in read_cells(spark, str(tmp_path)).collect()}
    assert cells == {(i, k): v for i, row in enumerate(rows) for k, v in enumerate(row) if v}


def test_wide_files_keep_their_cells(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(f"h{i}" for i in range(90)) + "\n" + ",".join(str(i) for i in range(90)) + "\n")
    cells = read_cells(spark, str(tmp_path / "wide.csv"))
    assert cells.count() == 180 and cells.where("col_idx = 89 and row_idx = 1").first().value == "89"


def test_files_with_equal_scores_are_solved_together(spark):
    r = random.Random(31)
    kinds = [[(f, c, r.choice([100.0, round(r.uniform(0.4, 1.3), 3)]), r.randint(0, 3), r.randint(0, 9)) for f in ("address", "buyer", "notes", "seller") for c in range(5)] for _ in range(6)]
    rows = [(n, *x) for n in range(300) for x in r.sample(kinds[n % 6], 20)]
    scores = spark.createDataFrame(rows, "file_no long, field string, col_idx int, score double, level int, alias_length int")
    got = {}
    for x in mapping.exact_assignment(scores).collect():
        got.setdefault(x.file_no, {})[x.field] = (x.col_idx, x.confidence)
    for n in range(300):
        at = {(f, c): (s, s + v * 1e-3 + a * 1e-6 - c * 1e-9) for f, c, s, v, a in kinds[n % 6]}
        names = sorted({f for f, _ in at})
        best = max(itertools.permutations(range(5), 4), key=lambda p: sum(at[f, c][1] for f, c in zip(names, p)))
        assert got[n] == {f: (c, round(min(at[f, c][0], 1.0), 3)) for f, c in zip(names, best) if at[f, c][0] >= mapping.THRESHOLD}
    assert "FlatMapGroupsInPandas" not in mapping.exact_assignment(scores)._jdf.queryExecution().toString()


def test_mutual_best_goes_on_until_nothing_is_left(spark):
    rows = [(0, f"f{i}", j, 1.0 + i + j) for i in range(7) for j in range(7)] + [(1, "f0", 0, 0.1)]
    scores = spark.createDataFrame(rows, "file_no long, field string, col_idx int, score double").withColumns({"level": F.lit(0), "alias_length": F.lit(0)})
    got = {(r.file_no, r.field, r.col_idx) for r in mapping.mutual_best(scores).collect()}
    assert got == {(0, f"f{i}", i) for i in range(7)}


def test_changes_in_order_latitudes_and_blocks(spark, monkeypatch):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, city string")
    changes = spark.createDataFrame([(1, "z", 1), (1, "c", 2)], "id long, city string, at int")
    assert {(r.id, r.city) for r in store.updated(base, changes, ["city"], order="at").collect()} == {(1, "c"), (2, "b")}
    far = spark.createDataFrame([(1, 75.0, 10.0), (2, 75.0, 10.2), (3, 75.0, 10.4), (4, -89.99, 0.0), (5, -89.99, 170.0), (6, None, 1.0)], "id long, latitude double, longitude double")
    pairs = radius.radius_join(far, far.withColumnRenamed("id", "subject_id"), 5.0)
    assert {(r.subject_id, r.id) for r in pairs.collect()} == {(i, i) for i in range(1, 6)} | {(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (5, 4)}
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 3)
    queries = spark.range(10).withColumnRenamed("id", "subject_id")
    pairs = matching.in_blocks(spark.range(4), queries, "subject_id")
    assert pairs.count() == 40 and pairs.distinct().count() == 40


def test_store_changes_only_its_buckets_and_refuses_a_second_writer(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"), store.SALE, buckets=8)
    s.append(spark.range(200).select("id", F.lit("a").alias("address"), F.col("id").cast("double").alias("sale_price")))
    number, before = s.version()
    s.update(spark.createDataFrame([(5, 1.5)], "id long, sale_price double"), ["sale_price"])
    after = s.version()[1]
    assert number == 1 and s.version()[0] == 2 and len(after) == 2
    (old, left), (new, moved) = [(k, after[k]) for k in (next(iter(before)), next(k for k in after if k not in before))]
    assert len(moved) == 1 and sorted(left + moved) == sorted(before[old]) and len(before[old]) == 8
    assert {(r.id, r.sale_price) for r in s.read().collect()} == {(i, 1.5 if i == 5 else float(i)) for i in range(200)}
    s.append(spark.createDataFrame([(900, "b")], "id long, address string"))
    assert sorted(map(len, s.version()[1].values()))[-1] == 7 and s.read().count() == 201
    held, other = s.read(), store.Store(spark, str(tmp_path / "s"), store.SALE, buckets=8)
    plain = store.deleted

    def meanwhile(rows, ids):
        monkeypatch.setattr(store, "deleted", plain)
        other.delete(spark.createDataFrame([(7,)], "id long"))
        return plain(rows, ids)

    monkeypatch.setattr(store, "deleted", meanwhile)
    with pytest.raises(store.Conflict):
        s.delete(spark.createDataFrame([(8,)], "id long"))
    assert {7, 8} & {r.id for r in s.read().collect()} == {8} and held.count() == 201  # the first change is there, the second is not, and readers keep their version
    s.delete(spark.createDataFrame([(8,), (12_345,)], "id long"))
    assert s.read().where("id in (7, 8)").count() == 0 and s.read().count() == 199


def test_arrivals_keep_their_state(spark, tmp_path):
    """A batch reads nothing that was stored before: known addresses stay known after the stored files are gone."""
    source, stored, checkpoint = (str(tmp_path / n) for n in ("in", "stored", "checkpoint"))
    schema = "id long, address string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: arrivals.run_arrivals(spark, source, schema, stored, checkpoint, ["id AS new_id", "address"])
    put([(4, "1 Oak Street"), (3, "1 oak st."), (5, None), (6, "!")])
    assert {(r.new_id, r.normalized) for r in run().collect()} == {(3, "1 oak st"), (5, ""), (6, "")}
    shutil.rmtree(stored)
    put([(1, "1 OAK ST"), (2, "2 Oak Street"), (7, "2 oak street"), (8, None)])
    put([(9, "2 Oak St"), (10, "3 Oak St")])
    assert {r.new_id for r in run().collect()} in ({2, 8, 10}, {9, 8, 10})  # whichever of the two files comes first
    known = str(tmp_path / "known")
    spark.createDataFrame([(1, "3 Oak Street")], schema).write.parquet(known)
    stream = spark.readStream.schema(schema).parquet(source).selectExpr("id AS new_id", "address")
    arrivals.save_new(stream, str(tmp_path / "other"), str(tmp_path / "c2"), spark.readStream.schema(schema).parquet(known)).awaitTermination()
    assert {r.new_id for r in spark.read.parquet(str(tmp_path / "other")).collect()} == {1, 2, 5, 6, 8}


def test_hours_of_events(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0), ("2024-01-01 11:00:00", "a", 4.0), ("2024-01-02 11:30:00", "b", 1.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = arrivals.hourly_events(spark, str(tmp_path / "e"), "ts timestamp, event_type string, value double", str(tmp_path / "out"), str(tmp_path / "c")).collect()
    assert [(str(r.hour), r.event_type, r.n, r.total) for r in got] == [("2024-01-01 10:00:00", "a", 2, 3.0)]


def test_smoothed_density(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 2, 1.0)], "cell_y long, cell_x long, weight double")
    got = {(r.cell_y, r.cell_x): r.heat for r in radius.smoothed(cells, 2).collect()}
    want = {}
    for y, x, w in ((0, 0, 2.0), (1, 2, 1.0)):
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy * dy + dx * dx < 9:
                    want[y + dy, x + dx] = want.get((y + dy, x + dx), 0) + w * (1 - (dy * dy + dx * dx) / 9) ** 2
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_mapping_of_files_as_a_whole(spark, tmp_path):
    """Close spellings, the greatest total, the file's name, vectors, and which header names the unit of a rate."""
    (tmp_path / "tenant list.csv").write_text("Adress,Tennant,Size SF,Rental Rate,Asking Rate /mo,Lease Trm\n1 Oak Street,Eve,1000,24.0,2.0,36\n2 Oak Street,Fay,2000,30.0,2.5,24\n")
    (tmp_path / "more leases.csv").write_text("Property Address,Tenant,Leased SF,Asking Rate /mo,Lease Term\n5 Oak Street,Gus,1000,5.25,36\n6 Oak Street,Hal,2000,6.5,24\n")
    (tmp_path / "leases 3.csv").write_text("Property Address,Tenant,Leased SF,Asking Rate /mo,Lease Term,Where it is\n7 Oak Street,Ida,1000,$5.25,36,near\n8 Oak Street,Jon,2000,$6.50,24,far\n")
    places = spark.createDataFrame([("1 Oak Street, TX", 29.1, -95.0, "Katy", "77001")], "address string, latitude double, longitude double, city string, zip_code string")
    rows = {r.address[:1]: r for r in flow.ingested(read_cells(spark, str(tmp_path)), places)["LEASE"].collect()}
    assert set(rows) == set("125678")
    assert (rows["1"].tenant_name, rows["1"].term_months, rows["1"].leased_sf, rows["1"].latitude) == ("Eve", 36.0, 1000.0, 29.1)
    assert rows["5"].rate_monthly == 5.25 and rows["5"].rate_annually == 63.0  # plain numbers: the mapped header names the unit
    assert rows["7"].rate_annually == 5.25  # money texts: the level of the rates decides
    heads = spark.createDataFrame([("where it is", [1.0, 0.0]), ("tenant", [0.0, 1.0])], "header string, header_vector array<double>")
    fields = spark.createDataFrame([("address", [0.0, 1.0]), ("notes", [0.9, 0.1])], "field string, field_vector array<double>")
    noted = {r.address[:1]: r for r in flow.ingested(read_cells(spark, str(tmp_path)), places, vectors=(heads, fields))["LEASE"].collect()}
    assert noted["7"].notes == "near" and noted["8"].notes == "far" and rows["7"].notes is None and noted["7"].raw_address_data == "Ida"


def test_scores_are_not_worked_out_again_in_joins(spark):
    """A ranking's filter stays above the scores: the lease query had them all, written out, in the condition of a join below."""
    import __spark_entry__ as e

    plan = e.queries()["match_leases_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ATAN2") == 1 and all("ATAN2" not in line for line in plan.splitlines() if "Join" in line)


def test_records_beside_many_subjects_use_all_cores(spark):
    """150 million pairs of a small file came in one task."""
    records = spark.range(0, 1_000, 1, 1)
    asked = lambda n: spark.range(n).withColumnRenamed("id", "subject_id")
    many = matching.in_blocks(records, asked(40), "subject_id")
    assert many.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and many.distinct().count() == 40_000
    assert matching.in_blocks(records, asked(2), "subject_id").rdd.getNumPartitions() == 1


def test_bounds_of_cells_are_compiled(spark):
    """No function of functions, which is interpreted row by row, and no filter on the result below its steps."""
    day = F.lit("2002-01-01").cast("date")
    cells = spark.range(5).selectExpr("id AS n", *[f"cast(id AS double) AS {k}_{f}" for f in ("latitude", "longitude", "building_size", "sale_price", "price_per_sf", "year_built") for k in ("low", "high", "s")],
                                      *[f"id AS n_{f}" for f in ("latitude", "building_size", "sale_price", "price_per_sf", "year_built", "closing_date")], "current_date() AS low_closing_date", "current_date() AS high_closing_date")
    found = matching._most(cells, ["latitude", "longitude", "building_size", "sale_price", "price_per_sf", "year_built"], matching.sale_bounds(day), matching.WEIGHTS).where("most >= 0.5")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "lambda" not in plan and plan.count("ATAN2") == 1 and found.where("most > 1.000001").count() == 0


def test_ratios_of_many_pairs_are_those_of_difflib():
    r = random.Random(3)
    first = ["".join(r.choices("abc 1é", k=r.randint(0, 30))) for _ in range(1_500)] + ["a" * 250, "\0a", "q", "日本x", ""]
    second = ["".join(c for c in x if r.random() > 0.1) if i % 2 else "".join(r.choices("abc 1é", k=r.randint(0, 30))) for i, x in enumerate(first[:1_500])] + ["a" * 249, "\0a", "q", "x日本", ""]
    want = [SequenceMatcher(None, x, y).ratio() if x or y else 0.0 for x, y in zip(first, second)]
    got = duplicates.ratios(first, second)
    assert [g for g, x, y in zip(got, first, second) if x or y] == [w for w, x, y in zip(want, first, second) if x or y]
    assert all(g == w if w >= 0.85 else g < 0.85 for g, w, x in zip(duplicates.ratios(first, second, 0.85), want, first) if x)


def test_candidates_are_compared_on_all_cores(spark):
    """Counts of addresses are few bytes; all their pairs came in a part or two."""
    r = random.Random(5)
    fresh, held = (spark.createDataFrame([(x,) for x in {a.lower() for a in streets(r, n)}], f"{c} string").coalesce(1) for c, n in (("a", 50), ("b", 400)))
    pairs = duplicates.candidates(fresh, held, lambda na, nb: F.ceil(0.3 * (na + nb)), 0.5)
    assert len({x.part for x in pairs.select(F.spark_partition_id().alias("part")).distinct().collect()}) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("size", [1, 7, 1_000])
def test_best_matches_of_a_batch_are_compared_together(monkeypatch, size):
    """Groups over several batches; no pair goes through ``difflib`` on its own."""
    import difflib

    import pandas as pd

    r = random.Random(6)
    every = [a.lower() for a in streets(r, 160)]
    rows, want = [], []
    for a in sorted(set(every[:25])):
        own = []
        for k, b in enumerate(every):
            m = SequenceMatcher(None, a, b)
            own.append((a, 0, b, k % 40, m.quick_ratio(), m.ratio()))
        own.sort(key=lambda x: (-x[4], x[3]))
        rows += [x[:5] for x in own]
        want.append((a, *min((-x[5], x[3]) for x in own)))
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    frame = pd.DataFrame(rows, columns=["a", "salt", "b", "first_id", "bound"])
    got = pd.concat(duplicates._rising(0.85)(iter([frame[k: k + size] for k in range(0, len(frame), size)])))
    assert [(x.a, -x.score, x.first_id) for x in got.itertuples()] == want and got["tried"].sum() < len(frame) / 4


def test_pairs_of_addresses_are_written_once(spark, monkeypatch):
    """However many listings share an address, its pairs are compared and written as two numbers and a score; the listings come last."""
    from parcelspark.sources.scratch import kept

    written = []

    def counted(df, name):
        out = kept(df, name)
        if name == "address-pairs":
            written.append((out.dtypes, out.count()))
        return out

    monkeypatch.setattr(duplicates, "kept", counted)
    r = random.Random(8)
    every = streets(r, 60)
    for join in (duplicates.by_ratio, duplicates.by_levenshtein):
        rows = {}
        for copies in (1, 20):
            s = spark.createDataFrame([(i, a) for i, a in enumerate(every * copies)], "id long, address string")
            n = spark.createDataFrame([(i, a.upper()) for i, a in enumerate(every[:20] * copies)], "new_id long, address string")
            rows[copies] = join(n, s, digits=3)
            assert rows[copies].where("score <> round(score, 3)").count() == 0
        assert rows[20].count() == 400 * rows[1].count() > 0
        assert written[-1] == written[-2] and [t for _, t in written[-1][0]] == ["bigint", "bigint", "double"]


def test_likeness_of_many_pairs_is_that_of_the_edit_distance():
    r = random.Random(4)
    first = ["".join(r.choices("abc 1é日", k=r.randint(0, 70))) for _ in range(600)] + ["a" * 64, "a" * 65, "", "x" * 300]
    second = ["".join(c for c in x if r.random() > 0.1) if i % 2 else "".join(r.choices("abc 1é日", k=r.randint(0, 70))) for i, x in enumerate(first[:600])] + ["a" * 64, "a" * 66, "abc", "y" + "x" * 280]

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    assert duplicates.likeness(first, second).tolist() == [1 - lev(x, y) / max(len(x), len(y), 1) for x, y in zip(first, second)]
    assert duplicates.likeness(second, first).tolist() == duplicates.likeness(first, second).tolist() and len(duplicates.likeness([], [])) == 0


def test_many_subjects_read_few_cells_and_leave_settings(spark, monkeypatch):
    """Bounds are worked out level by level, for few of all pairs of a subject and a narrow cell, in methods that the JVM compiles."""
    r = random.Random(14)
    schema = "latitude double, longitude double, building_size double, sale_price double, price_per_sf double, year_built double"
    one = lambda: (29 + r.random() * 1.5, -96 + r.random() * 1.3, r.lognormvariate(9, 1), r.lognormvariate(12, 1), None, float(r.randint(1960, 2024)))
    comps = spark.createDataFrame([(i, *one()) for i in range(4_000)], f"id long, {schema}").withColumn("closing_date", F.lit("2001-05-05").cast("date"))
    asked = spark.createDataFrame([(i, *one()) for i in range(20)], f"subject_id long, {schema}")
    day, made, limits = F.lit("2002-01-01").cast("date"), {}, {}
    name, plain = "spark.sql.codegen.hugeMethodLimit", matching.kept
    before = spark.conf.get(name)

    def counted(df, of):
        limits[of], made[of] = spark.conf.get(name), plain(df, of)
        return made[of]

    monkeypatch.setattr(matching, "kept", counted)
    dims = matching.sale_dimensions(day)
    got = matching.top_matches(comps, asked, dims, matching.sale_bounds(day), matching.WEIGHTS, matching.sale_cells(), 5)
    want = matching.ranked(matching.scored(comps, asked, dims, matching.WEIGHTS).withColumn("match_score", F.round("match_score", 6)), 5).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {limits[of] for of in ("top-bounds", "first-cells", "more-cells", "more-scores")} == {"8000"} and spark.conf.get(name) == before
    sizes = [made[f"{c}-cells"].count() for c in ("level0", "level1", "level2", "level3", "narrow")]
    assert sizes == sorted(sizes) and sizes[0] < 100
    assert made["top-bounds"].count() == 20 * sizes[0]


def test_bands_round_the_greatest_scores_only(spark):
    import __spark_entry__ as e

    plan = e.queries()["match_bands"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate [subject_id", 1)
    assert "* 100.0), 1)" in above and "* 100.0), 1)" not in below


def test_radius_join_compares_places_once(spark, monkeypatch):
    """Many records and subjects of a place: the distances are those of its pairs, and each record and subject is there; a crowded place is dealt out."""
    r = random.Random(16)
    spots = [(29 + r.random() / 5, -96 + r.random() / 5) for _ in range(12)]
    rows = [(i, *spots[min(11, int(r.expovariate(0.5)))]) for i in range(400)] + [(900, None, -96.0)]
    asked = [(i, *spots[i % 12]) for i in range(40)] + [(77, 29.1, None)]
    comps, subjects = spark.createDataFrame(rows, "id long, latitude double, longitude double"), spark.createDataFrame(asked, "subject_id long, latitude double, longitude double")
    met, plain = [], radius._near

    def counted(*args):
        met.append(plain(*args))
        return met[-1]

    monkeypatch.setattr(radius, "_near", counted)
    got = sorted(map(tuple, radius.radius_join(comps, subjects, 6.0, 50, digits=4).select("subject_id", "id", "distance_miles").collect()))
    assert met[0].count() <= 12 * 12
    want = sorted(map(tuple, plain(comps, subjects, 6.0, 50).select("subject_id", "id", F.round("distance_miles", 4)).collect()))
    assert got == want and len(got) > 3_000
