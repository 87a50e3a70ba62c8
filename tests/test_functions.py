"""Text, recurrence and calendar expressions on hand-made inputs."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from almanac.functions import calendar as C
from almanac.functions import labels as L
from almanac.functions import recurrence as R
from almanac.functions import text as T
from almanac.plans import ORACLE, QUERIES

from .harness import compare


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


RECURRENCES = {
    "Mandag": ("weekly", "FREQ=WEEKLY;BYDAY=MO", None),
    "Onsdager": ("weekly", "FREQ=WEEKLY;BYDAY=WE", None),
    "Mandagen": ("weekly", "FREQ=WEEKLY;BYDAY=MO", None),
    "Torsdag (også i ferien)": ("weekly", "FREQ=WEEKLY;BYDAY=TH", None),
    "Lørdag": ("weekly", "FREQ=WEEKLY;BYDAY=SA", None),
    "Annenhver tirsdag": ("biweekly", "FREQ=WEEKLY;BYDAY=TU;INTERVAL=2", None),
    "Mandag (annenhver, ulike uker)": ("biweekly", "FREQ=WEEKLY;BYDAY=MO;INTERVAL=2", "odd"),
    "Mandag annenhver, like uker": ("biweekly", "FREQ=WEEKLY;BYDAY=MO;INTERVAL=2", "even"),
    "Onsdag (oddetallsuker)": ("biweekly", "FREQ=WEEKLY;BYDAY=WE;INTERVAL=2", "odd"),
    "Onsdag (Oddetalsuker)": ("biweekly", "FREQ=WEEKLY;BYDAY=WE;INTERVAL=2", "odd"),
    "Torsdag (partalsuker)": ("biweekly", "FREQ=WEEKLY;BYDAY=TH;INTERVAL=2", "even"),
    "fredag annen-hver": ("biweekly", "FREQ=WEEKLY;BYDAY=FR;INTERVAL=2", None),
    "Første onsdag i måneden": ("monthly-nth", "FREQ=MONTHLY;BYDAY=WE;BYSETPOS=1", None),
    "1. tirsdag hver måned": ("monthly-nth", "FREQ=MONTHLY;BYDAY=TU;BYSETPOS=1", None),
    "Mandag (den andre i hver måned)": ("monthly-nth", "FREQ=MONTHLY;BYDAY=MO;BYSETPOS=2", None),
    "Fredag (1. og 3. i mnd)": ("monthly-nth", "FREQ=MONTHLY;BYDAY=FR;BYSETPOS=1,3", None),
    "Fredag (siste i mnd)": ("last-of-month", "FREQ=MONTHLY;BYDAY=FR;BYSETPOS=-1", None),
    "Torsdag (sent i måneden)": ("last-of-month", "FREQ=MONTHLY;BYDAY=TH;BYSETPOS=-1", None),
} | {x: ("irregular", None, None) for x in ("Fredag (månedlig)", "Mandag (én gang per måned)", "En gang i måneden", "Torsdag (eller fredag)", "Mandag (og fredag)", "Mandag (Søndag)", "En torsdag i måneden (varierer)", "Torsdag (utvalgte)", "Hver fjerde søndag", "Torsdag (hver tredje)", "", "?", "Sjekk facebook")}


def test_recurrence(spark):
    got = values(spark, R.parse_recurrence, [*RECURRENCES, None])
    assert [(r.kind, r.rrule, r.week_parity) for r in got[:-1]] == list(RECURRENCES.values())
    assert [r.raw for r in got[:-1]] == list(RECURRENCES) and got[-1] is None


def test_border_is_ascii(spark):
    # å is no word character to the rules, so a border lies between it and s.
    assert values(spark, lambda c: c.rlike(T.js_pattern(r"\bsport")), ["åsport", "xsport", "sport"]) == [True, False, True]


def test_time(spark):
    cases = {"19:00": "19:00", "19.00": "19:00", "9:05": "09:05", "19": "19:00", "kl 20": "20:00", "kl. 8": "08:00", "?": None, "": None, "-": None, "varierer": None, "25:00": None, "19:75": None, "fra 18:30 til 20:00": "18:30", "ukjent": None, " ": None}
    assert values(spark, T.normalize_time, [*cases, None]) == [*cases.values(), None]


VENUES = {
    "Bølgen Kro (Mikrobølgen 29, Munkelia)": ("Bølgen Kro", "Mikrobølgen 29, Munkelia"),
    "Café Marienlyst\n(«Hullet i veggen»), Kirkeveien 104)": ("Café Marienlyst", "Kirkeveien 104"),
    "Kjøkkenet (Rockefeller)": ("Kjøkkenet (Rockefeller)", None),
    "Stasjonen (Tordenskiolds gate)": ("Stasjonen (Tordenskiolds gate)", None),
    "Puben, Storgata 12": ("Puben", "Storgata 12"),
    "Storgata 12": ("Storgata 12", None),
    "  Mye   rom ": ("Mye rom", None),
    "": ("", None),
}


def test_clean_venue(spark):
    got = values(spark, T.clean_venue, [*VENUES, None])
    assert [(r.name, r.address_hint) for r in got[:-1]] == list(VENUES.values()) and got[-1] is None


def test_house_numbers_of_many_digits(spark, tmp_path):
    """The query's keys are house numbers, whatever their digits; others have four at most unless the caller says so."""
    path = f"{tmp_path}/supplier.parquet"
    keys = spark.range(9995, 10010).union(spark.range(123450, 123460)).union(spark.range(10**12, 10**12 + 5))
    keys.selectExpr("id AS s_suppkey", "concat('Supplier#', lpad(string(id), 9, '0')) AS s_name").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{path}/*.parquet'")
    got = compare(spark, con, str(tmp_path), QUERIES["op_b5_clean_venue"], ORACLE["op_b5_clean_venue"])
    assert sum(r[0] is not None for r in got) == 18
    assert [tuple(r) for r in values(spark, T.clean_venue, ["Puben (Storgata 12345)", "Puben, Storgata 12345", "Puben (Tlf 22334455)"])] == [("Puben (Storgata 12345)", None), ("Puben, Storgata 12345", None), ("Puben (Tlf 22334455)", None)]


def test_slug_and_ids(spark):
    cases = {"Bø i Telemark": "boe-i-telemark", "Ærlig & Ål": "aerlig-aal", "Café  Éclair!": "cafe-eclair", "Çà và": "ca-va", "日本": "", "--a--b--": "a-b", "Đorđe Þór": "dorde-thor"}
    assert values(spark, T.slug, cases) == list(cases.values())
    assert values(spark, lambda c: T.venue_id(c, c), ["", "Å"]) == ["ukjent-sted", "aa-aa"]
    none = F.lit(None).cast("string")
    assert values(spark, lambda c: T.event_id(c, F.lit("Pub"), none, none), ["Oslo"]) == ["oslo-pub-ukjent-natid"]


def test_labels_of_text(spark):
    cases = {"Allmenn": ["allmenn"], "Rock og film": ["musikk", "film"], "Sport/allmennquiz": ["allmenn", "sport"], "Seriespill": ["annet"], "Film – tv-serier": ["film"], "": ["annet"]}
    assert values(spark, T.classify_labels, [*cases, None]) == [*cases.values(), ["annet"]]
    assert values(spark, T.clean_category, ["a\n b  c"]) == ["a / b c"]


def test_places_and_names(spark):
    assert values(spark, T.strip_place_qualifier, ["Bø i Telemark", "Moss kommune", " Ski "]) == ["Bø", "Moss", "Ski"]
    assert values(spark, T.region_number, ["Hedmark", "Svalbard", "?"]) == ["34", None, None]
    assert values(spark, T.place_rank, ["By", "Gard", "?"]) == [100, 2, 35]
    assert values(spark, T.normalize_name, ["«The Fly» (x) & Café", "Bølgen's"]) == ["the fly og cafe", "boelgen s"]
    assert values(spark, lambda c: T.name_tokens(c, True), ["The Dirty Nelly Pub a"]) == [["dirty", "nelly"]]


def test_calendar(spark):
    d = dt.date
    assert values(spark, C.weekday_of, [d(2026, 7, 30)], "date") == ["torsdag"]
    assert values(spark, C.iso_week, [d(2027, 1, 1), d(2024, 12, 30)], "date") == [53, 1]
    noon = [dt.datetime(2026, 7, 1, 21, 59), dt.datetime(2026, 7, 1, 22, 0), dt.datetime(2026, 1, 1, 22, 59), dt.datetime(2026, 1, 1, 23, 0)]
    assert values(spark, C.local_date, noon, "timestamp_ntz") == [d(2026, 7, 1), d(2026, 7, 2), d(2026, 1, 1), d(2026, 1, 2)]
    with pytest.raises(Exception, match="not a civil date"):
        values(spark, C.civil_date, ["30.7.2026"])


def on(spark, raw, category, days, weekday):
    df = spark.createDataFrame([(raw, category, weekday, dt.date.fromisoformat(x)) for x in days], "raw string, category string, weekday string, d date")
    rule = R.parse_recurrence(F.col("raw"))
    return [r[0] for r in df.withColumn("r", rule).select(C.occurrence_on(F.col("weekday"), F.col("r"), F.col("category"), F.col("d"))).collect()]


def test_occurrence(spark):
    assert on(spark, "Fredag (den andre i hver måned)", "x", ["2026-08-14", "2026-08-07", "2026-09-11", "2020-02-14", "2099-01-09"], "fredag") == ["certain", "no", "certain", "certain", "certain"]
    assert on(spark, "Fredag (1. og 3. i mnd)", "x", ["2026-08-07", "2026-08-14", "2026-08-21"], "fredag") == ["certain", "no", "certain"]
    assert on(spark, "Fredag (siste i mnd)", "x", ["2026-08-28", "2026-10-30", "2026-10-23"], "fredag") == ["certain", "certain", "no"]
    assert on(spark, "Torsdag, vanligvis", "x", ["2026-07-30", "2026-07-31"], "torsdag") == ["likely", "no"]
    assert on(spark, "Torsdag", "Quiz en gang i måneden", ["2026-07-30"], "torsdag") == ["likely"]
    assert on(spark, "Torsdag annenhver", "x", ["2026-07-30"], "torsdag") == ["likely"]
    assert on(spark, "Torsdag (oddetallsuker)", "x", ["2026-07-30", "2026-08-06"], "torsdag") == ["certain", "no"]
    assert on(spark, "?", "x", ["2026-07-30"], None) == ["undated"]


def test_display(spark):
    assert values(spark, L.category_list, [["allmenn", "musikk", "film"], ["sport"], []], "array<string>") == ["Allmenn, musikk og film", "Sport", ""]
    assert values(spark, L.long_date, [dt.date(2026, 7, 27)], "date") == ["27. juli 2026"]
    assert values(spark, L.timestamp_label, [dt.datetime(2026, 7, 27, 2, 12)], "timestamp_ntz") == ["27. juli 2026 kl. 04:12"]
    assert values(spark, lambda c: L.join_path(F.lit("/x/"), c), ["a/ b", ""]) == ["/x/a/b/", "/x/"]
