"""Listing documents, keyed JSON files and nested responses of registers, as tables and back."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructField, StructType

from .paths import concatenate, exists, remove, stored

# ---- fixed values ----
AMENITIES = ("pub", "bar", "cafe", "restaurant", "nightclub", "biergarten", "casino", "community_centre", "arts_centre", "social_facility", "events_venue", "theatre")
TOURISM = ("hotel", "hostel", "guest_house")
LEISURE = ("sports_centre", "bowling_alley", "hackerspace", "dance")
# ---- end of fixed values ----

VENUE = "id string, name string, raw_name string, address_hint string, kommune string, fylke string, kommune_nr string, kommune_name string, fylke_now string, lat double, lon double, geo_source string, geo_confidence string, url string, url_broken boolean, stale boolean"
QUIZ = "id string, venue_id string, weekday string, time string, recurrence struct<kind:string,rrule:string,raw:string,week_parity:string>, category string, category_norm array<string>, note string, last_seen date, stale boolean"


def read_listing(spark: SparkSession, path: str, item_schemas: dict[str, str] | None = None, meta: str = "generated_at timestamp, source_updated_at date") -> dict[str, DataFrame]:
    """One JSON document as {array name: rows, "meta": one row}. Malformed JSON is an error, and so is a missing file (see read_previous()); unknown keys are ignored."""
    items = item_schemas or {"venues": VENUE, "quizzes": QUIZ}
    own = StructType.fromDDL(meta)
    whole = StructType([*own, *(StructField(n, ArrayType(StructType.fromDDL(s))) for n, s in items.items())])
    doc = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {n: doc.select(F.inline(n)) for n in items} | {"meta": doc.select(*own.names)}


def read_keyed_json(df: DataFrame, column: str, value_schema: str, ignored: tuple[str, ...] = ("_note",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (columns to keep, key, value) of the JSON objects in a string column, without notes; text that isn't an object gives none."""
    return df.select(*keep, F.explode(F.from_json(F.col(column), f"map<string,{value_schema}>")).alias("key", "value")).where(~F.col("key").isin(*ignored))


def snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name)


def camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def patches(rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """Rows (the key, the fields of schema, set_fields) of partial JSON objects: set_fields names the fields that are there, null or not.

    A field may be written as in the schema or in camel case; with both, the schema's spelling counts. Keys that the schema
    lacks are ignored, so a patch of none but these sets nothing. Text that isn't an object is an error; a null has no row.
    Of rows with one key only the fields count that the last object by its text sets: keys are distinct in a file.
    """
    fields = StructType.fromDDL(schema)
    failing = {"mode": "FAILFAST"}
    forms = {n: StructType([StructField(f(x.name), x.dataType) for x in fields if x.name != key or n == "own"]) for n, f in (("own", str), ("camel", camel))}
    d = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("_k"), F.col(column).alias("_j"), F.json_object_keys(column).alias("_keys"))
    d = d.withColumn("_keys", F.when(F.col("_keys").isNull(), F.raise_error(F.concat(F.lit("a patch isn't an object: "), F.col("_k"))).cast("array<string>")).otherwise(F.col("_keys")))
    d = d.groupBy("_k").agg(F.max_by("_keys", "_j").alias("_keys"), F.max("_j").alias("_j"))
    d = d.withColumns({f"_{n}": F.from_json("_j", s, failing) for n, s in forms.items()})
    has = lambda n: F.array_contains("_keys", n)
    names = [f for f in fields if f.name != key]
    value = lambda f: F.when(has(f.name), F.col(f"_own.{f.name}")).otherwise(F.col(f"_camel.{camel(f.name)}"))
    known = F.array_compact(F.array(*[F.when(has(f.name) | has(camel(f.name)), F.lit(f.name)) for f in fields]))
    return d.select(F.col("_k").alias(key), *[value(f).alias(f.name) for f in names], known.alias("set_fields"))


def read_overrides(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The sections of one JSON document of corrections, each as patches() by id: {"venues": {id: {field: value, ...}}, ...}.

    No file, and a section that isn't there, are no corrections; notes and other sections are ignored. Malformed JSON is an error.
    """
    sections = schemas or {"venues": VENUE, "quizzes": QUIZ}
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    whole = text.select(F.from_json("value", StructType([StructField(n, MapType(StringType(), StringType())) for n in sections]), {"mode": "FAILFAST"}).alias("_d"))
    return {n: patches(whole.select(F.explode(f"_d.{n}").alias("id", "_patch")), "id", "_patch", s) for n, s in sections.items()}


def read_previous(spark: SparkSession, path: str, **options) -> dict[str, DataFrame] | None:
    """read_listing(), or None if there is no file yet: a first run."""
    return read_listing(spark, path, **options) if exists(spark, path) else None


def _object(columns: list[str], nullable: tuple[str, ...]) -> Column:
    """A row as a JSON object. Null fields are left out, but for those in `nullable`, which stay as null."""
    members = [F.to_json(F.struct(*[c for c in columns if c not in nullable]))]
    for c in nullable:
        if c in columns:
            members.append(F.when(F.col(c).isNull(), F.lit(f'{{"{c}":null}}')).otherwise(F.to_json(F.struct(c))))
    inner = F.array(*[F.substring(m, F.lit(2), F.length(m) - 2) for m in members])
    return F.concat(F.lit("{"), F.array_join(F.filter(inner, lambda m: m != ""), ","), F.lit("}"))


def _scalar(c: Column, kind: DataType) -> Column:
    """A JSON value as JavaScript writes it: whole doubles have no point."""
    text = F.to_json(F.array(c))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(16,0)").cast("string")).otherwise(text) if isinstance(kind, (DoubleType, FloatType)) else text


def pretty(c: Column, kind: DataType, pad: str = "", nullable: tuple[str, ...] = ()) -> Column:
    """JSON of a value in the form with two spaces, lines behind the first indented by pad. Null fields are left out, but for those in `nullable`, which stay as null."""
    inner = pad + "  "
    if isinstance(kind, StructType):
        name = lambda f: F.lit(f"{inner}{json.dumps(f.name, ensure_ascii=False)}: ")
        member = lambda f: F.concat(name(f), pretty(c[f.name], f.dataType, inner, nullable))
        members = [F.when(c[f.name].isNotNull(), member(f)).otherwise(F.concat(name(f), F.lit("null")) if f.name in nullable else F.lit(None)) for f in kind]
        body = F.array_join(F.array_compact(F.array(*members)), ",\n")
        return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit(f"\n{pad}}}")))
    if isinstance(kind, ArrayType):
        items = F.transform(c, lambda x: F.concat(F.lit(inner), F.coalesce(pretty(x, kind.elementType, inner, nullable), F.lit("null"))))
        return F.when(F.size(c) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{pad}]")))
    return _scalar(c, kind)


def write_document(tables: dict[str, DataFrame], meta: DataFrame, path: str, key: str = "id", nullable: tuple[str, ...] = ()) -> None:
    """One JSON document in one file at path: the fields of meta (one row), then an array per table, its rows by key, then by their text. Two-space form.

    Equal input gives equal bytes, however it is partitioned, and keys may be repeated. Rows are range-sorted and written as
    parts by all tasks, each with a comma behind it; those equal to the last one are a part of their own, whose last row has none.
    The file system then puts the parts in order, by a stream that holds a megabyte. What was at path goes when all is there.
    """
    spark, work = meta.sparkSession, f"{path}.parts"
    head = meta.select(pretty(F.struct(*meta.columns), StructType(meta.schema.fields), "", tuple(meta.columns)).alias("o")).first()["o"]
    pieces: list[str | tuple[str]] = ["{\n" if head == "{}" else head[:-2] + (",\n" if tables else "\n")]
    for i, (name, df) in enumerate(tables.items()):
        end = ("," if i + 1 < len(tables) else "") + "\n"
        lines = stored(df.select(F.col(key).cast("string").alias("k"), F.concat(F.lit("    "), pretty(F.struct(*df.columns), StructType(df.schema.fields), "    ", nullable)).alias("value")), "lines")
        last = lines.agg(F.max(F.struct("k", "value")).alias("last")).first()["last"]
        if last is None:
            pieces.append(f"  {json.dumps(name)}: []{end}")
            continue
        ends = F.struct("k", "value").eqNullSafe(F.struct(F.lit(last["k"]).cast("string").alias("k"), F.lit(last["value"]).alias("value")))
        n = lines.where(ends).count()
        lines.where(~ends).orderBy("k", "value").select(F.concat("value", F.lit(",")).alias("value")).write.mode("overwrite").text(f"{work}/{i}-rows")
        spark.range(n).select(F.concat(F.lit(last["value"]), F.when(F.col("id") < n - 1, F.lit(",")).otherwise(F.lit(""))).alias("value")).write.mode("overwrite").text(f"{work}/{i}-last")
        pieces += [f"  {json.dumps(name)}: [\n", (f"{work}/{i}-rows",), (f"{work}/{i}-last",), f"  ]{end}"]
    concatenate(spark, [*pieces, "}\n"], path)
    remove(spark, work)


def write_keyed_json(df: DataFrame, path: str, key: str, locale: str | None = None) -> None:
    """JSON lines, each an object of one key and the row's other fields, by key: in code point order or as a locale sorts."""
    value = _object([c for c in df.columns if c != key], ())
    line = F.concat(F.lit("{"), F.regexp_replace(F.to_json(F.array(F.col(key))), r"^\[|\]$", ""), F.lit(":"), value, F.lit("}"))
    order = F.col("_key") if locale is None else F.collate("_key", locale)
    df.select(F.col(key).alias("_key"), line.alias("value")).orderBy(order).select("value").write.mode("overwrite").text(path)


def write_listing(df: DataFrame, path: str, key: str = "id", nullable: tuple[str, ...] = ()) -> None:
    """JSON lines in key order. Null fields are left out, but for those in `nullable`, which stay as null."""
    df.select(F.col(key).alias("_key"), _object(df.columns, nullable).alias("value")).orderBy("_key").select("value").write.mode("overwrite").text(path)


def map_places(elements: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """name, lat, lon, amenity of named map objects of a kind that could host an event, at their own point or centre. box: min_lon, min_lat, max_lon, max_lat."""
    tag = lambda n: F.col("tags")[n]
    kind = tag("amenity").isin(*AMENITIES) | tag("tourism").isin(*TOURISM) | tag("leisure").isin(*LEISURE) | tag("club").isNotNull()
    out = elements.where(kind).select(*[c for c in elements.columns if c not in ("lat", "lon", "center", "tags", "name", "amenity")], tag("name").alias("name"), F.coalesce("lat", F.col("center.lat")).alias("lat"), F.coalesce("lon", F.col("center.lon")).alias("lon"), tag("amenity").alias("amenity"))
    out = out.where((F.col("name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out if box is None else out.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def ring_box(ring: Column) -> Column:
    """Bounding box of an array of [lon, lat] points; null for none."""
    lon, lat = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.when(F.size(ring) > 0, F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat")))


def flatten_region(rows: DataFrame, ring: str = "ring", point: str = "point", name: str = "name", local_name: str = "local_name") -> DataFrame:
    """rows plus navn (the local name if there is one), point (lat, lon) and bbox; both null if either is missing."""
    box = ring_box(F.col(ring))
    p = F.when(F.size(point) >= 2, F.struct(F.get(F.col(point), F.lit(1)).alias("lat"), F.get(F.col(point), F.lit(0)).alias("lon")))
    whole = box.isNotNull() & p.isNotNull()
    kept = [c for c in rows.columns if c not in (ring, point, name, local_name)]
    return rows.select(*kept, F.coalesce(F.nullif(F.col(local_name), F.lit("")), F.col(name)).alias("navn"), F.when(whole, p).alias("point"), F.when(whole, box).alias("bbox"))


def flatten_hits(rows: DataFrame, regions: str = "kommuner", point: str = "point", name: str = "navn", query: str = "query") -> DataFrame:
    """rows with kommunenummer, kommunenavn of the first region and lat, lon; those missing either are dropped. The name defaults to the query."""
    first = F.get(F.col(regions), F.lit(0))
    kept = [c for c in rows.columns if c not in (regions, point, name)]
    out = rows.select(*kept, F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(query)).alias("navn"), first["nr"].alias("kommunenummer"), first["navn"].alias("kommunenavn"), F.col(f"{point}.lat").alias("lat"), F.col(f"{point}.lon").alias("lon"))
    return out.where("kommunenummer is not null and lat is not null and lon is not null")


def flatten_addresses(rows: DataFrame, text: str = "adressetekst", region: str = "kommunenummer", point: str = "representasjonspunkt") -> DataFrame:
    """rows with address, nr, lat, lon; those without a region or a point are dropped."""
    kept = [c for c in rows.columns if c not in (text, region, point)]
    out = rows.select(*kept, F.col(text).alias("address"), F.col(region).alias("nr"), F.col(f"{point}.lat").alias("lat"), F.col(f"{point}.lon").alias("lon"))
    return out.where("nr is not null and lat is not null and lon is not null")
