"""Grids, polygons, ranks, overrides from a file, and ladders that are broken off, against brute force."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from almanac.operators import build, geo, grid, ladder, merge, resolve, skew
from almanac.sources import listing

from .harness import compare
from .test_operators import LISTED, RAW, REGISTER, rows

RING = "nr string, rings array<array<struct<lon:double,lat:double>>>"
BOX = "nr string, bbox struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"


def square(x, y, s):
    return [(float(x), float(y)), (float(x + s), float(y)), (float(x + s), float(y + s)), (float(x), float(y + s))]


def inside(lat, lon, rings):
    n = 0
    for r in rings or []:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if y1 > y2:
                x1, y1, x2, y2 = x2, y2, x1, y1
            n += (y1 > lat) != (y2 > lat) and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) < lon
    return n % 2 == 1


def some_points(rnd):
    pts = [(rnd.randrange(0, 41) / 4, rnd.randrange(0, 41) / 4) for _ in range(300)] + [(rnd.random() * 10, rnd.random() * 10) for _ in range(200)]
    return pts + [(None, 1.0), (math.nan, 1.0), (1.0, math.inf), (1.0, None)]


def finite(p):
    return all(x is not None and math.isfinite(x) for x in p)


@pytest.mark.parametrize("size", [0.25, 0.6, 3.0])
def test_points_in_polygons(spark, size):
    rnd = random.Random(3)
    pts = some_points(rnd)
    ring = lambda: [(rnd.randrange(0, 21) / 2, rnd.randrange(0, 21) / 2) for _ in range(rnd.randint(3, 7))]
    regs = [(f"{i:04d}", [ring() for _ in range(rnd.randint(1, 2))]) for i in range(10)] + [(f"g{i}{j}", [square(1 + i / 2, 1 + j / 2, 0.5)]) for i in range(4) for j in range(4)]
    regs += [("hole", [square(2, 2, 6), square(3, 3, 2)]), ("closed", [[*square(2, 2, 6), (2.0, 2.0)]]), ("none", None), ("empty", []), ("point", [[(1.0, 1.0)]])]
    holed = [(x, None if i == 2 else y) for i, (x, y) in enumerate([(1.0, 1.0), (7.0, 1.0), (7.5, 3.0), (7.0, 6.0), (1.0, 6.0)])]
    got = grid.point_in_regions(spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame([*regs, ("lacking", [holed])], RING), size=size)
    regs.append(("lacking", [[p for p in holed if p[1] is not None]]))
    want = sorted({(*p, n) for p in pts if finite(p) for n, r in regs if inside(*p, r)})
    assert sorted(tuple(r) for r in got.collect()) == want
    tiles = [x[:2] for x in want if x[2].startswith("g")]
    assert len(tiles) == len(set(tiles)) > 10  # a point on a shared border is in one region
    assert not any(3 < x[0] < 5 and 3 < x[1] < 5 for x in want if x[2] == "hole")


@pytest.mark.parametrize("small", [20_000, 0])
def test_rows_of_one_number_are_one_region(spark, monkeypatch, small):
    """Rings of several rows count together: equal ones cancel, one within another is a hole. Without a number there is no region."""
    monkeypatch.setattr(skew, "SMALL", small)
    rnd = random.Random(5)
    pts = some_points(rnd)
    regs = [("twice", [square(1, 1, 4)]), ("twice", [square(1, 1, 4)]), ("holed", [square(2, 2, 6)]), ("holed", [square(3, 3, 2)]), ("apart", [square(0, 0, 1.5)]), ("apart", [square(8, 8, 1.5)]), ("apart", None), (None, [square(0, 0, 9)])]
    regs += [("thrice", [square(i / 4, i / 4, 5), square(2, 2, 1)]) for i in range(3)]
    whole = {}
    for n, r in regs:
        whole.setdefault(n, []).extend(r or [])
    got = grid.point_in_regions(spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame(regs, RING))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(*p, n) for p in pts if finite(p) for n, r in whole.items() if n and inside(*p, r)})


def plan_length(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_plan_of_point_in_polygon_is_short(spark):
    """What makes the rings is in it once; repeated, it was 328,828 characters, of which a driver ran out of memory."""
    assert plan_length(__spark_entry__.queries()["op_e13_point_in_polygon"](spark, "/root/testdata/sf0.001")) < 50_000


def test_plan_of_verify_by_polygons_is_short(spark):
    """As above; it was 345,000 characters."""
    assert plan_length(__spark_entry__.queries()["op_e13_verify_by_polygons"](spark, "/root/testdata/sf0.001")) < 50_000


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """Suppliers whose numbers are cut to four digits, beside those that have these already, and customers."""
    path = str(tmp_path_factory.mktemp("long"))
    spark.range(600).selectExpr("id * 37 AS c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.range(100, 130).union(spark.range(1000, 1010)).union(spark.range(10000, 10025)).union(spark.range(100120, 100140)).selectExpr("id AS s_suppkey", "concat('Supplier#', lpad(string(id), 9, '0')) AS s_name").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["op_a9_e12_places_by_box", "op_e13_point_in_polygon", "op_e13_verify_by_polygons"])
def test_keys_of_many_digits(spark, long_keys, name):
    path, con = long_keys
    assert len(compare(spark, con, path, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])) > 100


@pytest.mark.parametrize("small", [20_000, 0])
def test_points_in_boxes(spark, monkeypatch, small):
    """Small and large boxes, borders, turned and null ones; broadcast, and joined with crowded cells split."""
    monkeypatch.setattr(skew, "SMALL", small)
    monkeypatch.setattr(skew, "SPLIT", 20)
    rnd = random.Random(4)
    pts = some_points(rnd) + [(5.0, 5.0)] * 50
    boxes = [(f"b{i}", (float(x), float(y), float(x + w), float(y + h))) for i in range(50) for x, y, w, h in [(rnd.randrange(0, 20) / 2, rnd.randrange(0, 20) / 2, rnd.choice([0, 0.25, 1, 9, -1]), rnd.choice([0, 0.5, 2, 400]))]] + [("null", None)]
    p, b = spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame(boxes, BOX)
    for m in (0.0, 0.25):
        want = sorted((*p, n) for p in pts if finite(p) for n, x in boxes if x and x[1] - m <= x[3] + m and x[0] - m <= x[2] + m and x[1] - m <= p[0] <= x[3] + m and x[0] - m <= p[1] <= x[2] + m)
        assert sorted(tuple(r) for r in grid.box_join(p, b, margin=m).collect()) == want
    assert grid.box_join(p, b.limit(0)).collect() == grid.box_join(p.limit(0), b).collect() == []


def test_verification_by_polygons(spark):
    """Two regions in one cell, each with a box full of its neighbour."""
    a, b = [(10.0, 60.0), (10.2, 60.0), (10.2, 60.2)], [(10.0, 60.0), (10.2, 60.2), (10.0, 60.2)]
    regions = spark.createDataFrame([("0001", [a]), ("0002", [b])], RING).withColumn("bbox", grid.ring_box(F.col("rings")))
    points = spark.createDataFrame([(1, 60.05, 10.15, "0001"), (2, 60.05, 10.15, "0002"), (3, 60.15, 10.05, "0002"), (4, 60.1, 11.0, "0001"), (5, 60.1, 11.0, "7777"), (6, 60.1, 11.0, None), (7, 0.0, 0.0, None)], "id int, lat double, lon double, kommune_nr string")
    assert rows(grid.by_polygons(regions)(points), "id", "why") == [(1, None), (2, "region"), (3, None), (4, "box"), (5, None), (6, None), (7, "country")]
    # Map objects get their regions from boxes; the polygon then decides about the best match.
    v = spark.createDataFrame([("1", "Puben", "0001", "En", "En"), ("2", "Puben", "0002", "To", "To")], "id string, name string, kommune_nr string, kommune_name string, kommune string")
    objects = spark.createDataFrame([("Puben", 60.05, 10.15)], "place_name string, lat double, lon double")
    placed = geo.map_rung(v, grid.assign_regions(objects, regions), grid.by_polygons(regions))
    assert rows(placed, "id", "lon") == [("1", 10.15)]


def test_unknown_numbers_and_repeated_rows(spark):
    v = spark.createDataFrame([("1", "9999", "Gata 1"), ("2", None, "Gata 1"), ("3", "0301", "Gata 1")], "id string, kommune_nr string, address_hint string")
    a = spark.createDataFrame([("Gata 1", "3103", 59.5, 10.2, 1), ("Gata 1", "0301", 59.5, 10.1, 2)], "address string, nr string, lat double, lon double, ord int")
    register = spark.createDataFrame([("0301",), ("3103",)], "nr string")
    assert rows(geo.address_rung(v, a, regions=register), "id", "lon") == [("1", 10.2), ("2", 10.2), ("3", 10.1)]
    point = "id string, lat double, lon double, geo_source string, geo_confidence string"
    twice = spark.createDataFrame([("1", 2.0, 2.0, "osm", "high"), ("1", 1.0, 2.0, "osm", "high"), ("2", 1.0, 1.0, "address", "high")], point)
    again = spark.createDataFrame([("3", 5.0, 2.0, "osm", "low"), ("3", 4.0, 2.0, "centroid", "low"), ("1", 9.0, 9.0, "manual", "high")], point)
    assert rows(geo.ladder(v, [lambda d: again], cached=twice), "id", "lat", "geo_source") == [("1", 1.0, "osm"), ("2", 1.0, "address"), ("3", 4.0, "centroid")]
    lookup = spark.createDataFrame([(59.5, 10.1, "0301"), (59.5, 10.1, "0301"), (59.5, 10.1, "0500")], "lat double, lon double, found_nr string")
    boxes = spark.createDataFrame([("0301", (10.0, 59.0, 11.0, 60.0))], BOX)
    one = spark.createDataFrame([("3", 59.5, 10.1, "0301")], "id string, lat double, lon double, kommune_nr string")
    assert rows(geo.by_lookup(boxes, lookup)(one), "id", "verified") == [("3", True)]


def test_null_counties(spark):
    reg = spark.createDataFrame(REGISTER, "nr string, navn string, fylkesnr string, fylke string")
    places = spark.createDataFrame([("Oslo", None), ("Oslo", None), ("Oslo", "Oslo"), ("Oslo kommune", None), ("Våler", None), ("Nowhere", None)], "place string, fylke string")
    assert rows(resolve.resolve_direct(places, reg), "place", "fylke", "status", "method") == [("Nowhere", None, "none", None), ("Oslo kommune", None, "resolved", "normalized"), ("Oslo", "Oslo", "resolved", "exact"), ("Oslo", None, "resolved", "exact"), ("Våler", None, "ambiguous", None)]
    hits = spark.createDataFrame([("Nowhere", "Nowhere", "By", "0301")], "query string, navn string, type string, kommunenummer string")
    assert rows(resolve.resolve_gazetteer(places, hits, reg).where("place = 'Nowhere'"), "status", "candidates") == [("unresolved", ["Nowhere [By] -> Oslo"])]


@pytest.mark.parametrize("most", [None, 60])
def test_ranks(spark, most):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, 1, 2, 3]), i // 2) for i in range(500)]
    df = spark.createDataFrame(data, "g string, t int, i int").repartition(5)
    got = skew.ranked(df, ["g"], [F.asc_nulls_last("t"), F.col("i")], "n", most=most).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [(r.g, r.t, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == own
        assert sorted(r.n for r in got if r.g == g) == list(range(1, len(own) + 1))
    same = df.withColumn("g", F.lit("x")).withColumn("t", F.lit(1)).withColumn("i", F.lit(1))
    assert sorted(r.n for r in skew.ranked(same, ["g"], [F.col("t")], "n", most=most).collect()) == list(range(1, 501))
    assert skew.ranked(df.limit(0), ["g"], [F.col("t")], "n", most=most).collect() == []


def test_overrides_from_their_file(spark, tmp_path):
    file = tmp_path / "overrides.json"
    file.write_text(json.dumps({"_note": {"a": [1]}, "venues": {"oslo-puben": {"lat": None, "kommuneNr": "0301", "name": "Ny", "_note": 1}, "ski-kro": {"stale": True, "last_seen": "2020-01-01"}, "x": {"zzz": 1}, "y": {}}, "quizzes": {"q": {"recurrence": {"kind": "weekly"}, "weekday": None, "categoryNorm": ["film"]}}}))
    got = listing.read_overrides(spark, str(file))
    assert rows(got["venues"], "id", "set_fields") == [("oslo-puben", ["name", "kommune_nr", "lat"]), ("ski-kro", ["stale"]), ("x", []), ("y", [])]
    q = got["quizzes"].first()
    assert (q.set_fields, q.recurrence.kind, q.category_norm) == (["weekday", "recurrence", "category_norm"], "weekly", ["film"])
    assert {n: d.count() for n, d in listing.read_overrides(spark, f"{tmp_path}/none.json").items()} == {"venues": 0, "quizzes": 0}
    for text in ("{", '{"venues": {"a": 5}}', '{"venues": {"a": "text"}}', '{"venues": {"a": {"lat": "north"}}}'):
        file.write_text(text)
        with pytest.raises(Exception):
            listing.read_overrides(spark, str(file))["venues"].collect()
    # From file to patched rows: what is in the snapshot isn't stale, whatever the patch says; what has gone may be patched back.
    file.write_text(json.dumps({"venues": {"oslo-puben": {"url": None, "name": "Ny", "stale": True}, "ski-kro": {"stale": False}}}))
    df = spark.createDataFrame(LISTED, RAW)
    first = build.build(df, "2026-07-28", min_rows=1, max_churn=1.0)
    patch = listing.read_overrides(spark, str(file))["venues"]
    second = build.build(df.where("row_idx <> 4"), "2026-07-29", previous=(first.venues, first.events), venue_patch=patch, min_rows=1, max_churn=1.0)
    assert rows(second.venues, "id", "name", "url", "stale") == [("oslo-puben", "Ny", None, False), ("ski-kro", "Kro", None, False)]
    assert merge.apply_to_snapshot(df, None) is df


def test_ladder_goes_on_where_it_stopped(spark, tmp_path):
    v = spark.createDataFrame([(str(i), f"{i % 4:04d}" if i % 5 else None) for i in range(40)] + [(None, "0001"), ("7", "0003")], "id string, kommune_nr string")
    asked = []

    def rung(name, every, fail=()):
        def run(d):
            ids = [r.id for r in d.collect()]
            asked.append((name, len(ids)))
            if len(asked) in fail:
                raise RuntimeError(name)
            return d.where(F.col("id").cast("int") % every == 0).select("id", F.lit(60.0).alias("lat"), F.lit(10.0).alias("lon"), F.lit(name).alias("geo_source"), F.lit("low").alias("geo_confidence"))

        return name, run

    def result(path, **o):
        return rows(ladder.run_ladder(v, [rung("a", 2), rung("b", 3), rung("c", 1)], f"{tmp_path}/{path}", per_batch=12, **o), "id", "geo_source")

    whole, lookups = result("whole"), list(asked)
    assert whole == sorted((str(i), "a" if i % 2 == 0 else "b" if i % 3 == 0 else "c") for i in range(40)) and len(lookups) > 6
    # Broken in the second batch, behind its second rung.
    asked.clear()
    with pytest.raises(RuntimeError):
        ladder.run_ladder(v, [rung("a", 2), rung("b", 3), rung("c", 1, fail=(6,))], f"{tmp_path}/broken", per_batch=12)
    before = list(asked)
    asked.clear()
    assert result("broken") == whole and before[:-1] + asked == lookups
    # A later run finds all of it in the store.
    asked.clear()
    assert result("broken") == [] and asked == [] and ladder.points(spark, f"{tmp_path}/broken").count() == 40
    # The limit: the first by region and id, and no batch is begun once they are placed.
    ordered = sorted(((f"{i % 4:04d}" if i % 5 else "9999", str(i)) for i in range(40)))
    got = result("limit", limit=9)
    assert [x[0] for x in got] == sorted(i for _, i in ordered[:9]) and len(asked) == 3
    asked.clear()
    more = result("limit", limit=9)
    assert len(more) == 9 and not {x[0] for x in more} & {x[0] for x in got}
    # A failing rung is left out where that is asked for, and its venues go on to the next.
    told = []
    asked.clear()
    out = ladder.run_ladder(v, [rung("a", 2, fail=(1, 2, 3, 4)), rung("c", 1)], f"{tmp_path}/skip", skip_failing=lambda n, e: told.append(n))
    assert told == ["a"] and {r.geo_source for r in out.collect()} == {"c"}
    assert ladder.run_ladder(v.limit(0), [rung("a", 2)], f"{tmp_path}/empty").collect() == []
