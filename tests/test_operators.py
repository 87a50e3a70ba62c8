"""Ingest, deduplication, merge, matching and geo operators on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import audits, build, dedupe, geo, match, merge, resolve, views
from almanac.sources import html, listing


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


PAGE = """<p>Sist oppdatert: 7.3.2026</p><table class="x" id="quiz-table"><tbody>
<tr><td colspan="6"><strong>Akers&amp;hus</strong></td></tr>
<tr><td>&nbsp;</td><td>Ski</td><td><a href="https://a.example/?a=1&amp;b=2" class="x broken_link">Puben<br>Storgata 1</a></td><td><a href="#">Mandag</a></td><td><p>18:00</p><p>20:00</p></td><td><p>Allmenn</p><p>Musikk</p></td></tr>
<tr><td></td><td>&Aring;s</td><td><a class="broken_link" href="https://www.facebook.com/x">Kro&#233;n</a></td><td>Tirsdag</td><td>&nbsp;</td><td>A<br/>B</td></tr>
<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>odd</td></tr>
<tr><td></td><td>Moss</td><td> </td><td></td><td></td><td></td></tr>
<tr><td></td><td></td><td></td><td></td><td></td><td></td></tr>
<tr><th colspan=6>Nord</th></tr>
<tr><td></td><td>Bodø</td><td>Bar</td><td>Onsdag</td><td>1<br>2</td><td>a<br>b<br>c</td></tr>
</tbody></table>"""


def test_table_rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got, warned = html.html_table_rows(pages, "quiz-table")
    assert rows(got, "fylke", "city", "venue_raw", "venue_url", "venue_url_broken", "weekday_raw", "time_raw", "category_raw") == sorted(
        [
            ("Akers&hus", "Ski", "Puben\nStorgata 1", "https://a.example/?a=1&b=2", True, "Mandag", "18:00", "Allmenn"),
            ("Akers&hus", "Ski", "Puben\nStorgata 1", "https://a.example/?a=1&b=2", True, "Mandag", "20:00", "Musikk"),
            ("Akers&hus", "Ås", "Kroén", "https://www.facebook.com/x", None, "Tirsdag", "", "A\nB"),
            ("Nord", "Bodø", "Bar", None, None, "Onsdag", "1\n2", "a\nb\nc"),
        ],
        key=repr,
    )
    assert [w[0] for w in rows(warned, "page_id")] == [1, 1, 2, 3]
    with pytest.raises(Exception, match="no table on page"):
        html.html_table_rows(pages, "quiz-table", missing="error")[0].collect()
    odd = spark.createDataFrame([(1, "<table id=a.b><tr><td>1</td><td>Ski</td><td><a class=broken_link href='https://a.example/x'>P</a></td><td>Mandag</td><td>1</td><td>c</td></tr></table>")], "page_id long, html string")
    got, warned = html.html_table_rows(odd, "a.b")
    assert rows(got, "venue_url", "venue_url_broken") == [("https://a.example/x", True)] and html.html_table_rows(odd, "a+b")[0].collect() == []
    assert rows(pages.select(html.source_updated_at(F.col("html")).alias("d")), "d") == [("2026-03-07",), (None,), (None,)]


def test_cell_text(spark):
    df = spark.createDataFrame([("<p>a&nbsp; b</p><div>c &lt;d&gt; &amp;eacute; &eacute; &#x1F600;</div>e<br>f<b>g</b>",)], "x string")
    assert df.select(html.cell_text(F.col("x"))).first()[0] == "a b\nc <d> &eacute; é 😀\ne\nfg"


def test_split_and_links(spark):
    df = spark.createDataFrame([(1, "a\nb", "x\ny"), (2, "a\nb", "x"), (3, "a\nb", "x\ny\nz"), (4, "a", "x")], "i int, t string, c string")
    assert rows(html.split_row_variants(df, "t", "c"), "i", "t", "c") == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "x"), (3, "a\nb", "x\ny\nz"), (4, "a", "x")]
    lint = spark.createDataFrame([(1, '<a href="/x/a/"><a href="/a/"><img src="//cdn"><a href="/">')], "page_id long, html string")
    assert rows(html.link_lint(lint, "/x/"), "link") == [("/a/",)]


def test_listing_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 1.5, None), ("a", "mandag", None, "n")], "id string, weekday string, lat double, note string")
    listing.write_listing(df, f"{tmp_path}/out", "id", ("weekday",))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert lines == ['{"id":"a","note":"n","weekday":"mandag"}', '{"id":"b","lat":1.5,"weekday":null}']
    (tmp_path / "doc.json").write_text('{"_note": 1, "generated_at": "2026-07-28T04:00:00Z", "venues": [{"id": "a", "name": "A", "x": 1}], "quizzes": [{"id": "q", "venue_id": "a"}]}')
    got = listing.read_listing(spark, f"{tmp_path}/doc.json")
    assert rows(got["venues"], "id", "name", "lat") == [("a", "A", None)] and got["meta"].count() == 1
    keyed = spark.createDataFrame([('{"_note": "x", "a": "1", "b": null}',)], "j string")
    assert rows(listing.read_keyed_json(keyed, "j", "string"), "key", "value") == [("a", "1"), ("b", None)]


def test_unique_ids(spark):
    df = spark.createDataFrame([(1, "pub", "weekly", "x"), (2, "pub", "weekly", "x"), (3, "pub", "weekly", "x"), (4, "pub-2", "weekly", "y"), (5, "pub", "last", "x")], "i int, base string, h1 string, h2 string")
    got = dict(rows(dedupe.make_unique(df, "base", ["h1"], "i"), "i", "unique_id"))
    assert got == {1: "pub", 2: "pub-weekly", 3: "pub-3", 4: "pub-2", 5: "pub-last"}


def test_slug_map(spark):
    a = [("Bø", "Telemark"), ("Boe", "Nordland"), ("BØ", "Telemark"), ("???", "Oslo"), ("!!!", "??")]
    for order in (a, a[::-1]):
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(order)], "i int, v string, q string")
        got = dict(rows(dedupe.slug_map(df, "v", "q", "i"), "v", "slug"))
        assert got == {"Boe": "boe", "BØ": "boe-telemark", "Bø": "boe-2", "???": "oslo", "!!!": "sted"}


def test_merge(spark):
    cur = spark.createDataFrame([("a", "n"), ("b", "n")], "id string, name string")
    prev = spark.createDataFrame([("b", "old", dt.date(2026, 1, 1), True), ("c", "old", dt.date(2026, 1, 2), False)], "id string, name string, last_seen date, stale boolean")
    got = merge.soft_delete(cur, prev, "id", "2026-07-28")
    assert rows(got, "id", "last_seen", "stale") == [("a", dt.date(2026, 7, 28), False), ("b", dt.date(2026, 7, 28), False), ("c", dt.date(2026, 1, 2), True)]
    assert rows(merge.new_ids(cur, prev, "id"), "id") == [("a",), ("b",)] and rows(merge.removed_ids(cur, prev, "id"), "id") == [("c",)]
    first = merge.build_report(cur, prev.limit(0), "id")
    assert first.first().churn == 0.0
    assert rows(merge.check_rails(first, min_rows=2), "rail") == [] and rows(merge.check_rails(first, min_rows=3, force=True), "rail", "blocks") == [("rows", False)]
    patch = spark.createDataFrame([("a", None, ["name"]), ("b", "p", [])], "id string, name string, set_fields array<string>")
    assert rows(merge.apply_overrides(cur, patch), "id", "name") == [("a", None), ("b", "n")]
    assert merge.same_except(cur, cur.withColumn("name", F.lit("z")), ["name"]).first().same
    assert not merge.same_except(cur, cur.unionByName(cur.limit(1)), []).first().same
    bad = spark.createDataFrame([("a", "x", ["id"])], "id string, name string, set_fields array<string>")
    with pytest.raises(Exception, match="may not change"):
        merge.apply_overrides(cur, bad).collect()


PAIRS = [
    ("Dirty Nelly", "Dirty Nelly Pub", None, "exact"), ("Bølgen Kro", "Bølgen", None, "exact"), ("Flyfisher", "The Fly Fisher", None, "exact"), ("Kvarteret", "Kvarterett", None, "fuzzy"),
    ("Skatten", "Skatten Oslo", "Oslo", "strong"), ("Postkontoret på Tøyen", "Postkontoret", None, "strong"), ("Grand Hotel", "Grand hotell Egersund", "Eigersund Egersund", "strong"),
    ("Bar 1", "Bar 9", None, None), ("Café Sør", "Café Nord", None, None), ("Pub", "Puben på hjørnet", None, None), ("Bølgen Kro", "Bølgen & Moi", None, None), ("Hinna Bistro", "Dolly Dimples Hinna", None, None),
    ("Kjøkkenet (Rockefeller)", "Kjøkken og Bar", None, None), ("Heim Jessheim", "Jessheim pizzeria", "Ullensaker Jessheim", None), ("Heim Jessheim", "Heim", "Ullensaker Jessheim", "strong"),
]


def test_match_names(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a string, b string, p string, want string")
    got = match.match_names(df, "a", "b", match.place_tokens(F.coalesce("p", F.lit("")))).orderBy("i").collect()
    assert [(r.a, r.b, r.match and r.match.kind) for r in got] == [(r.a, r.b, r.want) for r in got]
    d = spark.createDataFrame([("flyfisher", "fly fisher")], "a string, b string")
    assert d.select(match.dice(F.col("a"), F.col("b"))).first()[0] == pytest.approx(14 / 17)


def test_block_join_loses_nothing(spark):
    a = spark.createDataFrame([(i, "k", p[0]) for i, p in enumerate(PAIRS)] + [(99, None, "Dirty Nelly")], "id int, block string, name string")
    b = spark.createDataFrame([("k", p[1], 59.0 + i, 10.0) for i, p in enumerate(PAIRS)], "block string, place_name string, lat double, lon double")
    got = match.fuzzy_block_join(a, b, "block")
    every = match.match_names(a.join(b, "block"), "name", "place_name").where("match is not null")
    assert rows(got, "id", "place_name", "lat") == rows(every, "id", "place_name", "lat")
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abcdeø ") for _ in range(rnd.randint(0, 14))) for _ in range(60)]
    edited = [n[:k] + rnd.choice("abcdeø ") + n[k + rnd.randint(0, 1) :] for n in names for k in [rnd.randint(0, max(0, len(n) - 1))]]
    x = spark.createDataFrame([(i, str(i % 2), n) for i, n in enumerate(names)], "id int, block string, name string")
    y = spark.createDataFrame([(str(i % 2), n, 1.0, 1.0) for i, n in enumerate(edited)], "block string, place_name string, lat double, lon double")
    every = match.match_names(x.join(y, "block"), "name", "place_name").where("match is not null")
    assert rows(match.fuzzy_block_join(x, y, "block"), "id", "place_name") == rows(every, "id", "place_name") != []
    two = spark.createDataFrame([("k", "Puben Sør", 59.91, 10.75), ("k", "Puben Sør", 59.93, 10.78)], "block string, place_name string, lat double, lon double")
    one = spark.createDataFrame([(1, "k", "Puben Sør")], "id int, block string, name string")
    assert rows(match.best_match(match.fuzzy_block_join(one, two, "block"), "id"), "ambiguous") == [(True,)]
    near = two.withColumn("lat", F.lit(59.91)).withColumn("lon", F.col("lon") * 0 + 10.75)
    assert rows(match.best_match(match.fuzzy_block_join(one, near, "block"), "id"), "ambiguous") == [(False,)]


REGISTER = [("0301", "Oslo", "03", "Oslo"), ("1867", "Bø", "18", "Nordland"), ("3103", "Moss", "31", "Østfold"), ("3114", "Våler", "31", "Østfold"), ("3118", "Indre Østfold", "31", "Østfold"), ("3209", "Ullensaker", "32", "Akershus"), ("3236", "Jevnaker", "32", "Akershus"), ("3419", "Våler", "34", "Innlandet"), ("4020", "Midt-Telemark", "40", "Telemark")]


def test_resolution(spark):
    reg = spark.createDataFrame(REGISTER, "nr string, navn string, fylkesnr string, fylke string")
    places = spark.createDataFrame([("Jevnaker", "Oppland"), ("Våler", "Østfold"), ("Våler", "Hedmark"), ("Våler", "Nordland"), ("Bø i Telemark", "Telemark")], "place string, fylke string")
    got = {(r.place, r.fylke): (r.status, r.kommune_nr, r.method) for r in resolve.resolve_direct(places, reg).collect()}
    assert got == {("Jevnaker", "Oppland"): ("resolved", "3236", "exact"), ("Våler", "Østfold"): ("resolved", "3114", "normalized"), ("Våler", "Hedmark"): ("resolved", "3419", "normalized"), ("Våler", "Nordland"): ("ambiguous", None, None), ("Bø i Telemark", "Telemark"): ("none", None, None)}
    hits = spark.createDataFrame([("Bø i Telemark", "Bø", "Tettsted", "4020"), ("Bø i Telemark", "Bø", "Grend", "1867"), ("Rygge", "Rygge", "Gard", "3118"), ("Rygge", "Rygge", "Sokn", "3103"), ("Jessheim", "Jessheim", "Tettsted", "3209"), ("X", "Jessheimbyen", "By", "3209")], "query string, navn string, type string, kommunenummer string")
    asked = spark.createDataFrame([("Bø i Telemark", "Telemark"), ("Rygge", "Østfold"), ("Jessheim", "Nordland"), ("X", "Akershus"), ("Longyearbyen", "Svalbard")], "place string, fylke string")
    got = {r.place: r.kommune_nr for r in resolve.resolve_gazetteer(asked, hits, reg).collect()}
    assert got == {"Bø i Telemark": "4020", "Rygge": "3103", "Jessheim": None, "X": None, "Longyearbyen": None}


def test_geo(spark):
    pts = [(59.91, 10.75), (69.65, 18.96), (78.2232, 15.6267), (0.0, 0.0), (math.nan, 1.0), (math.inf, 1.0), (51.5, -0.1), (59.33, 18.07), (None, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, lat double, lon double")
    got = [r.c.region for r in df.select("i", geo.check_in_region(F.col("lat"), F.col("lon")).alias("c")).orderBy("i").collect()]
    assert got == ["mainland", "mainland", "svalbard", None, None, None, None, "mainland", None]
    km = df.limit(1).select(geo.distance_km(F.lit(59.91), F.lit(10.75), F.lit(60.39), F.lit(5.32))).first()[0]
    assert 290 < km < 320
    venues = spark.createDataFrame([(str(i), "0301", "x") for i in range(4)] + [("9", "3103", "x")], "id string, kommune_nr string, kommune string")
    regions = spark.createDataFrame([("0301", (59.9, 10.7)), ("3103", (59.4, 10.6))], "nr string, point struct<lat:double,lon:double>")
    assert rows(geo.centroid_rung(venues, regions), "id", "geo_confidence") == [("9", "low")]
    broken = lambda d: d.select("nothing")
    seen = []
    out = geo.ladder(venues, [broken, lambda d: geo.centroid_rung(d, regions)], skip_failing=seen.append)
    assert rows(out, "id") == [("9",)] and len(seen) == 1


def test_groups_and_credits(spark):
    df = spark.createDataFrame([("Å", 1), ("Z", 2), ("Ø", 3), ("A", 4)], "k string, v int")
    assert [r.k for r in views.group_sorted(df, "k", "v", ["v"]).collect()] == ["A", "Z", "Ø", "Å"]
    d = spark.createDataFrame([("b", None, 1), ("a", None, 2), ("z", "18:00", 3)], "name string, time string, id int")
    assert [r.id for r in dedupe.sort_by_time_name(d).collect()] == [3, 2, 1]
    v = spark.createDataFrame([("osm", 1.0, 1.0), ("osm", None, None), ("new", 1.0, 1.0)], "geo_source string, lat double, lon double")
    owed, unknown = views.data_credits(v)
    assert rows(owed, "credit") == [("kartverket",), ("openstreetmap",)] and rows(unknown, "geo_source") == [("new",)]
    with pytest.raises(ValueError, match="default place"):
        views.require_default_place(df.withColumnRenamed("k", "kommune"), "Oslo")


RAW = "row_idx long, fylke string, city string, venue_raw string, venue_url string, venue_url_broken boolean, weekday_raw string, time_raw string, category_raw string"
LISTED = [
    (1, "Oslo", "Oslo", "Puben (Storgata 1)", None, None, "Mandag", "19:00", "Allmenn"), (2, "Oslo", "Oslo", "Puben", "https://a.example", None, "Mandag (siste i mnd)", "19:00", "Musikk"),
    (3, "Oslo", "Oslo", "Puben", None, None, "Mandag", "19:00", "Film"), (4, "Oslo", "Ski", "Kro", None, None, "Tirsdag", None, ""), (5, None, "Ski", "Bar", None, None, "Tirsdag", "20", ""),
]


def test_build(spark):
    df = spark.createDataFrame(LISTED, RAW)
    make = lambda d, **o: build.build(d, "2026-07-28", **({"min_rows": 1, "max_churn": 1.0} | o))
    first = make(df)
    assert rows(first.venues, "id", "address_hint", "url") == [("oslo-puben", "Storgata 1", "https://a.example"), ("ski-kro", None, None)]
    assert rows(first.events, "id") == [("oslo-puben-mandag-19-00",), ("oslo-puben-mandag-19-00-last-of-month",), ("oslo-puben-mandag-19-00-weekly",), ("ski-kro-tirsdag-natid",)]
    assert rows(first.rejects, "row_idx", "reason") == [(5, "no county")] and first.report.first().churn == 0.0
    for order in (df.orderBy(F.desc("row_idx")), df.repartition(3)):
        again = make(order)
        assert sorted(map(repr, again.events.collect())) == sorted(map(repr, first.events.collect())) and sorted(map(repr, again.venues.collect())) == sorted(map(repr, first.venues.collect()))
    # One event goes; the others stay.
    second = make(df.where("row_idx <> 4"), previous=(first.venues, first.events))
    assert rows(second.events.where("stale"), "id") == [("ski-kro-tirsdag-natid",)] and second.report.first().n_removed == 1
    third = make(df, previous=(second.venues, second.events))
    assert third.events.where("stale").count() == 0
    with pytest.raises(build.Rejected, match="rails trip: churn, rows"):
        make(df.where("row_idx <> 4"), previous=(first.venues, first.events), min_rows=9, max_churn=0.1)
    forced = make(df.where("row_idx <> 4"), previous=(first.venues, first.events), min_rows=9, max_churn=0.1, force=True)
    assert rows(forced.rails, "rail", "blocks") == [("churn", False), ("rows", False)]
    # The schema comes before the rails, and no force helps.
    cache = spark.createDataFrame([("ski-kro", 99.0, 10.0, "osm", "sure")], "venue_id string, lat double, lon double, geo_source string, geo_confidence string")
    with pytest.raises(build.Rejected, match="geo_confidence: ski-kro\n.*lat: ski-kro"):
        make(df, cache=cache, min_rows=9, force=True)


def test_rungs_verify(spark):
    """A rejected hit falls to the next rung; addresses are tried in turn, the gazetteer's and the map's best only once."""
    regions = spark.createDataFrame([("0301", (10.0, 59.0, 11.0, 60.0))], "nr string, bbox struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>")
    lookup = spark.createDataFrame([(59.5, 10.1, "0301"), (59.5, 10.2, "3201"), (59.5, 10.3, "0301"), (59.5, 10.4, "3201")], "lat double, lon double, found_nr string")
    verify = geo.by_lookup(regions, lookup)
    v = spark.createDataFrame([("1", "Puben", "0301", "Oslo", "Oslo", "Gata 1")], "id string, name string, kommune_nr string, kommune_name string, kommune string, address_hint string")
    a = spark.createDataFrame([("Gata 1", "0301", 59.5, 10.2, 1), ("gata 1", "0301", 59.5, 10.1, 2)], "address string, nr string, lat double, lon double, ord int")
    assert rows(geo.address_rung(v, a, verify), "lon") == [(10.1,)] and rows(geo.address_rung(v, a.where("ord = 1"), verify), "lon") == []
    p = spark.createDataFrame([("Puben Oslo", "0301", 59.5, 10.3), ("Puben", "0301", 59.5, 10.4)], "place_name string, kommune_nr string, lat double, lon double")
    assert rows(geo.map_rung(v, p, verify), "lon") == [] and rows(geo.map_candidates(v, p, verify), "why") == [("region",)]
    assert rows(geo.map_rung(v, p.where("lon < 10.35"), verify), "lon", "geo_source", "geo_confidence") == [(10.3, "osm", "medium")]
    h = spark.createDataFrame([("Puben", "By", "0301", 59.5, 10.2), ("Puben", "Gard", "0301", 59.5, 10.1)], "navn string, type string, nr string, lat double, lon double")
    assert rows(geo.gazetteer_rung(v, h, verify), "lon") == []
    fails = lambda d: d.select("id", F.raise_error(F.lit("down")).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit("x").alias("geo_source"), F.lit("low").alias("geo_confidence"))
    seen = []
    out = geo.ladder(v, [fails, lambda d: geo.address_rung(d, a, verify)], skip_failing=seen.append)
    assert rows(out, "geo_source") == [("address",)] and len(seen) == 1
    cached = spark.createDataFrame([("1", 1.0, 2.0, "manual", "high"), ("7", 1.0, 2.0, "manual", "high")], "id string, lat double, lon double, geo_source string, geo_confidence string")
    assert rows(geo.ladder(v, [lambda d: geo.address_rung(d, a, verify)], cached=cached), "id", "geo_source") == [("1", "manual")]


def test_bare_weekdays(spark):
    raw = ["Mandag", " mandager ", "LØRDAG", "Mandag 1/9-15/12", "Mandager (2024)", "mandagen", "lordag", "Mandag (start 29.7)"]
    items = spark.createDataFrame([(i, "mandag", ("weekly", "R", r)) for i, r in enumerate(raw)], "id int, weekday string, recurrence struct<kind:string,rrule:string,raw:string>")
    got = audits.unexplained_weekly_audit(items, spark.createDataFrame([(7,), (8,)], "id int"))
    assert rows(got, "id", "problem") == [(3, "unexplained"), (4, "unexplained"), (5, "unexplained"), (6, "unexplained"), (8, "gone")]


def test_sinks_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([("Å", "x"), ("Z", None), ('a"b', "y")], "place string, nr string")
    listing.write_keyed_json(df, f"{tmp_path}/k", "place", "nb")
    assert [r.value for r in spark.read.text(f"{tmp_path}/k").collect()] == ['{"a\\"b":{"nr":"x"}}'.replace('"x"', '"y"'), '{"Z":{}}', '{"Å":{"nr":"x"}}']
    assert listing.read_previous(spark, f"{tmp_path}/none.json") is None
    a = spark.createDataFrame([("Gata 1", "0301", (1.0, 2.0)), ("Gata 2", None, (1.0, 2.0)), ("Gata 3", "0301", None)], "adressetekst string, kommunenummer string, representasjonspunkt struct<lat:double,lon:double>")
    assert rows(listing.flatten_addresses(a), "address", "nr", "lon") == [("Gata 1", "0301", 2.0)]
    reg = spark.createDataFrame(REGISTER, "nr string, navn string, fylkesnr string, fylke string")
    hits = spark.createDataFrame([("Bø", "Bø", "Tettsted", "4020")], "query string, navn string, type string, kommunenummer string")
    asked = spark.createDataFrame([("Bø i Telemark", "Telemark"), ("Å i Å", "Telemark")], "place string, fylke string")
    got = resolve.resolve_gazetteer(asked, hits, reg)
    assert rows(got, "place", "kommune_nr") == [("Bø i Telemark", "4020"), ("Å i Å", None)]
    assert rows(resolve.to_curate(got), "place") == [("Å i Å",)]
    n = spark.createDataFrame([("d", t, i) for i, t in enumerate(["b", None, "a", "b", None])], "g string, t string, i int")
    assert rows(dedupe.numbered(n, "g", "t", [F.col("i")], "no"), "i", "no") == [(0, 2), (1, 4), (2, 1), (3, 3), (4, 5)]
