"""From a page's rows to the published listing, as one plan: clean, merge with what was there, validate, hold against the rails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.recurrence import parse_recurrence, parse_weekday
from ..sources.paths import stored
from . import audits, merge
from .dedupe import dedupe_first_wins, make_unique
from .skew import spread_join
from .views import require_fields


class Rejected(ValueError):
    """The listing breaks its schema, or trips a rail."""


@dataclass
class Built:
    """Tables of a build. rails are those that trip (with force they don't stop it)."""

    venues: DataFrame
    events: DataFrame
    rejects: DataFrame
    report: DataFrame
    rails: DataFrame


def parse_recurrences(df: DataFrame, text: str, out: str = "recurrence") -> DataFrame:
    """df plus parse_recurrence() of a text column, made once for each distinct text: listings have few of them, and many rows. Null texts have null."""
    some = df.where(F.col(text).isNotNull())
    parsed = stored(some.select(F.col(text)).distinct().withColumn(out, parse_recurrence(F.col(text))), "recurrences")
    met = spread_join(some.drop(out), parsed, [text])
    rest = df.drop(out).where(F.col(text).isNull()).withColumn(out, F.lit(None).cast(parsed.schema[out].dataType))
    return met.unionByName(rest).select(*[c for c in df.columns if c != out], out)


def normalise_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(venues, events, rejects) from raw rows (row_idx, fylke, city, venue_raw, venue_url, venue_url_broken, weekday_raw, time_raw, category_raw).

    Rows without a place, county or venue name are rejects with a reason. The first row of a venue names it; link and address
    come from the first row that has them. Events that would share an id are told apart by kind, then by label, then by number.
    """
    d = rows.withColumn("_v", T.clean_venue(F.col("venue_raw"))).withColumn("name", F.col("_v.name")).withColumn("address_hint", F.col("_v.address_hint")).drop("_v")
    good, rejects = require_fields(d, {"place": F.col("city"), "county": F.col("fylke"), "venue": F.col("name")})
    good = good.withColumn("venue_id", T.venue_id(F.col("city"), F.col("name")))
    good = parse_recurrences(good.withColumn("_raw", F.coalesce("weekday_raw", F.lit(""))), "_raw").drop("_raw").withColumn("weekday", parse_weekday(F.coalesce("weekday_raw", F.lit("")))).withColumn("time", T.normalize_time(F.col("time_raw")))
    good = stored(good.withColumn("category", T.clean_category(F.coalesce("category_raw", F.lit("")))).withColumn("category_norm", T.classify_labels(F.col("category"))), "rows")
    venues = good.select(F.col("venue_id").alias("id"), "row_idx", "name", F.col("venue_raw").alias("raw_name"), F.col("city").alias("kommune"), "fylke", F.col("venue_url").alias("url"), F.col("venue_url_broken").alias("url_broken"), "address_hint")
    venues = dedupe_first_wins(venues, "id", "row_idx", [["url", "url_broken"], ["address_hint"]]).drop("row_idx")
    base = T.event_id(F.col("city"), F.col("name"), F.col("weekday"), F.col("time"))
    events = make_unique(good.withColumn("_base", base).withColumn("_kind", F.col("recurrence.kind")).withColumn("_label", F.get("category_norm", F.lit(0))), "_base", ["_kind", "_label"], "row_idx", "id")
    return venues, events.select("id", "venue_id", "weekday", "time", "recurrence", "category", "category_norm"), rejects


def build(rows: DataFrame, today: str, previous: tuple[DataFrame, DataFrame] | None = None, aliases: DataFrame | None = None, cache: DataFrame | None = None, venue_patch: DataFrame | None = None, event_patch: DataFrame | None = None, min_rows: int = merge.MIN_ROWS, max_churn: float = merge.MAX_CHURN, force: bool = False) -> Built:
    """Venues and events of a snapshot, merged with the previous (venues, events), if there are any.

    Order: enrichment from aliases (place, ...) and the cache of points (venue_id, ...), soft deletion, overrides (which so
    win, for stale rows too; but what is in the snapshot is never stale), then the schema, then the rails. A row that breaks the schema is an error whatever `force` says,
    with the first ten in its text; rails that trip are an error unless forced. Equal input gives equal tables.
    """
    venues, events, rejects = normalise_rows(rows)
    places = ["kommune_nr", "kommune_name", "fylke_now"]
    points = ["lat", "lon", "geo_source", "geo_confidence"]
    if aliases is not None:
        venues = merge.enrich(venues, aliases.withColumnRenamed("place", "kommune"), "kommune", places)
    if cache is not None:
        venues = merge.enrich(venues, cache.withColumnRenamed("venue_id", "id"), "id", points)
    kinds = {"kommune_nr": "string", "kommune_name": "string", "fylke_now": "string", "lat": "double", "lon": "double", "geo_source": "string", "geo_confidence": "string"}
    venues = venues.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in venues.columns})
    before = previous or (_none(venues), _none(events))
    current_events = events
    venues, events = (merge.soft_delete(now, old, "id", today) for now, old in zip((venues, events), before, strict=True))
    venues, events = merge.apply_to_snapshot(venues, venue_patch), merge.apply_to_snapshot(events, event_patch)
    venues, events = stored(venues, "venues"), stored(events, "events")
    broken = audits.validate(venues, audits.schema_rules(venues, audits.VENUE), "id").unionByName(audits.validate(events, audits.schema_rules(events, audits.EVENT), "id"))
    if issues := audits.first_issues(broken):
        raise Rejected("the listing breaks its schema:\n  - " + "\n  - ".join(issues))
    report = merge.build_report(current_events, before[1], "id", venues=venues)
    rails = merge.check_rails(report, min_rows, max_churn, force)
    if trips := [r["rail"] for r in rails.where("blocks").collect()]:
        raise Rejected("rails trip: " + ", ".join(sorted(trips)))
    return Built(venues, events, rejects, report, rails)


def _none(df: DataFrame) -> DataFrame:
    """No rows, with the columns that a previous snapshot would have."""
    return df.where(F.lit(False)).withColumn("last_seen", F.lit(None).cast("date")).withColumn("stale", F.lit(False))
