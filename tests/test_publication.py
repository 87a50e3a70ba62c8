"""Documents byte by byte, publication, alias upkeep, schema rules by path, recurrences by distinct text."""

import json

import pytest
from pyspark.sql import functions as F

from almanac.functions.recurrence import parse_recurrence
from almanac.operators import audits, build, publish, resolve
from almanac.sources import listing

from .test_operators import LISTED, RAW, REGISTER, rows

ITEM = "id string, name string, lat double, weekday string, rec struct<kind:string,raw:string>, tags array<string>, stale boolean"
ITEMS = [
    ("b", 'q"\\\n\tØ/', 59.0, None, ("weekly", None), ["x", "y"], False), ("a", "n", 10.25, "mandag", None, [], None), ("c", None, None, None, (None, None), None, True),
    ("c", None, None, None, (None, None), None, True), ("c", "later", -0.5, None, ("k", "r"), ["z"], True), ("z", "last", 1.0, None, None, None, None), ("z", "last", 1.0, None, None, None, None),
]


def plain(row):
    """A row as the object that the document should hold."""
    return {k: (int(v) if isinstance(v, float) and v == int(v) else {a: b for a, b in v.items() if b is not None} if isinstance(v, dict) else v) for k, v in row.asDict(True).items() if v is not None or k == "weekday"}


def test_document_byte_by_byte(spark, tmp_path):
    """The two-space form, repeated keys, an empty array, any number of partitions."""
    df = spark.createDataFrame(ITEMS, ITEM)
    meta = spark.range(1).select(F.lit("2026-07-28T04:00:00.000Z").alias("generated_at"), F.lit(None).cast("string").alias("source_updated_at"))
    want = {"generated_at": "2026-07-28T04:00:00.000Z", "source_updated_at": None, "venues": [], "items": [plain(r) for r in sorted(df.collect(), key=lambda r: (r.id, r.name == "later"))]}
    seen = set()
    for d in (df, df.repartition(7), df.coalesce(1).orderBy(F.desc("id")), df.repartition(3, "id")):
        listing.write_document({"venues": df.limit(0), "items": d}, meta, f"{tmp_path}/doc.json", nullable=("weekday",))
        seen.add((tmp_path / "doc.json").read_text())
    assert len(seen) == 1
    text = seen.pop()
    items = json.loads(text)["items"]
    assert sorted(map(json.dumps, items)) == sorted(map(json.dumps, want["items"])) and [i["id"] for i in items] == ["a", "b", "c", "c", "c", "z", "z"]
    assert text == json.dumps(want | {"items": items}, indent=2, ensure_ascii=False) + "\n"
    assert not [p.name for p in tmp_path.iterdir() if p.name.endswith((".parts", ".new"))]
    listing.write_document({}, meta, f"{tmp_path}/head.json")
    assert json.loads((tmp_path / "head.json").read_text()) == {"generated_at": "2026-07-28T04:00:00.000Z", "source_updated_at": None}


def test_publication_keeps_its_timestamp(spark, tmp_path):
    first = build.build(spark.createDataFrame(LISTED, RAW), "2026-07-28", min_rows=1, max_churn=1.0)
    tables, path, doc = {"venues": first.venues, "quizzes": first.events}, f"{tmp_path}/p", f"{tmp_path}/doc.json"
    assert publish.published(spark, path) is None
    one = publish.publish(tables, "2026-07-28 04:00:00", path, "2026-07-01", document=doc)
    text = (tmp_path / "doc.json").read_text()
    assert one.changed and json.loads(text)["generated_at"] == "2026-07-28T04:00:00.000Z"
    # What is read back meets the same rows: nothing is written.
    old = publish.published(spark, path)
    again = build.build(spark.createDataFrame(LISTED, RAW).orderBy(F.desc("row_idx")), "2026-07-28", previous=(old["venues"], old["quizzes"]), min_rows=1, max_churn=1.0)
    two = publish.publish({"venues": again.venues.repartition(3), "quizzes": again.events}, "2026-07-29 04:00:00", path, "2026-07-01", document=doc)
    assert not two.changed and two.path == one.path and two.generated_at == one.generated_at and (tmp_path / "doc.json").read_text() == text
    three = publish.publish({"venues": again.venues, "quizzes": again.events.unionByName(again.events.limit(1))}, "2026-07-30 04:00:00", path, "2026-07-01")
    four = publish.publish(tables, "2026-07-31 04:00:00", path, "2026-07-02")
    assert three.changed and four.changed and str(publish.published(spark, path)["meta"].first().generated_at).startswith("2026-07-31")
    # A publication that is broken off isn't one.
    with pytest.raises(Exception):
        publish.publish({"venues": first.venues, "quizzes": first.events.withColumn("x", F.raise_error(F.lit("no")))}, "2026-08-01 04:00:00", path)
    assert str(publish.published(spark, path)["meta"].first().generated_at).startswith("2026-07-31")
    assert first.report.first().n_venues == 2 and first.report.first().n_stale_venues == 0


def test_alias_upkeep(spark):
    reg = spark.createDataFrame(REGISTER, "nr string, navn string, fylkesnr string, fylke string")
    hits = spark.createDataFrame([("Rygge", "Rygge", "Sokn", "3103")], "query string, navn string, type string, kommunenummer string")
    venues = spark.createDataFrame([(1, "Å", "Oslo"), (2, "Oslo", None), (3, "Rygge", "Østfold"), (4, "Moss", "Østfold"), (5, "Ørsta", "x"), (6, None, "x"), (7, "Moss", "Oslo"), (8, "Zeta", "x")], "row_idx int, place string, fylke string")
    entry = "place string, kommune_nr string, kommune_name string, fylke_now string, method string, note string"
    known = spark.createDataFrame([("Å", "9998", "x", "y", "stedsnavn", "b"), ("Å", "9999", "x", "y", "manual", "a"), ("Zeta", None, None, None, "odd", None), ("Gone", "1", "x", "y", "exact", None)], entry)
    table, open_, report = resolve.keep_aliases(venues, reg, hits, known)
    want = [("Gone", "1", "exact"), ("Moss", "3103", "exact"), ("Oslo", "0301", "exact"), ("Rygge", "3103", "stedsnavn"), ("Zeta", None, "odd"), ("Å", "9999", "manual")]
    assert [(r.place, r.kommune_nr, r.method) for r in table.collect()] == want  # in Norwegian order, curated rows untouched
    assert rows(open_, "place") == [("Ørsta",)] and dict(rows(report, "metric", "n")) == {"places": 6, "known": 2, "resolved": 3, "unresolved": 1}
    second, open_, report = resolve.keep_aliases(venues, reg, hits, table)
    assert [tuple(r) for r in second.collect()] == [tuple(r) for r in table.collect()] and dict(rows(report, "metric", "n"))["resolved"] == 0 and rows(open_, "place") == [("Ørsta",)]
    empty = resolve.keep_aliases(venues.limit(0), reg, hits, known.limit(0))
    assert empty[0].collect() == empty[1].collect() == []


def test_schema_rules_by_path(spark):
    df = spark.createDataFrame([(i,) for i in range(1)], "i int")
    good = df.select(F.lit("a").alias("id"), F.lit("v").alias("venue_id"), F.lit(None).cast("string").alias("weekday"), F.lit("18:00").alias("time"), F.struct(F.lit("weekly").alias("kind"), F.lit("r").alias("raw")).alias("recurrence"), F.lit("").alias("category"), F.array(F.lit("film")).alias("category_norm"), F.lit("2026-07-28").cast("date").alias("last_seen"))
    broken = lambda d, fields: [p for _, p in rows(audits.validate(d, audits.schema_rules(d, fields), "id"), "id", "path")]
    text = lambda v: F.lit(v).cast("string")
    assert broken(good, audits.EVENT) == []
    cases = {
        "id": text(None), "venue_id": text(""), "weekday": text("Mandag"), "time": text("18:00\n"), "category": text(None), "recurrence": F.lit(None).cast("struct<kind:string,raw:string>"),
        "recurrence.kind": F.struct(text(None).alias("kind"), F.lit("r").alias("raw")), "recurrence.raw": F.struct(F.lit("weekly").alias("kind"), text(None).alias("raw")),
        "recurrence.week_parity": F.struct(F.lit("weekly").alias("kind"), F.lit("r").alias("raw"), F.lit("even ").alias("week_parity")), "last_seen": F.lit(None).cast("date"),
    }
    for path, value in cases.items():
        assert broken(good.withColumn(path.split(".")[0], value), audits.EVENT) == [path], path
    for value in (F.array().cast("array<string>"), F.array(text(None)), F.array(F.lit("x")), F.lit(None).cast("array<string>")):
        assert broken(good.withColumn("category_norm", value), audits.EVENT) == ["category_norm"]
    assert broken(good.drop("weekday", "category"), audits.EVENT) == ["category", "weekday"] and broken(good.drop("recurrence"), audits.EVENT) == ["recurrence"]
    assert broken(good.withColumn("recurrence", F.struct(F.lit("weekly").alias("kind"))), audits.EVENT) == ["recurrence.raw"]
    venue = df.select(*[F.lit("x").alias(c) for c in ("id", "name", "raw_name", "kommune", "fylke")])
    assert broken(venue, audits.VENUE) == []
    for path, value in {"kommune_nr": text("1234\n"), "lat": F.lit(float("nan")), "lon": F.lit(-181.0), "geo_source": text("guess"), "kommune_name": text(""), "fylke": text(None), "raw_name": text(None)}.items():
        assert broken(venue.withColumn(path, value), audits.VENUE) == [path], path


def test_recurrences_by_distinct_text(spark):
    raw = ["Mandag", "Tirsdag (annenhver)", None, "", "Mandag", None]
    df = spark.createDataFrame([(i, x, "own") for i, x in enumerate(raw)], "i int, raw string, recurrence string")
    got = build.parse_recurrences(df, "raw")
    one = df.drop("recurrence").withColumn("recurrence", parse_recurrence(F.col("raw")))
    assert got.columns == ["i", "raw", "recurrence"] and rows(got, "i", "raw", "recurrence") == rows(one, "i", "raw", "recurrence")
    assert build.parse_recurrences(df.limit(0), "raw").collect() == []
