"""Filters, groupings, counts and listings over joined items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import expand_occurrences, is_undated
from ..functions.recurrence import WEEKDAYS
from .dedupe import collated

# ---- fixed values ----
MAP_CREDIT, REGISTER_CREDIT = "openstreetmap", "kartverket"
CREDITS = {"osm": (MAP_CREDIT, REGISTER_CREDIT), "kartverket": (REGISTER_CREDIT,), "address": (REGISTER_CREDIT,), "centroid": (REGISTER_CREDIT,), "manual": ()}
CREDIT_ORDER = (MAP_CREDIT, REGISTER_CREDIT)
# ---- end of fixed values ----


def is_stale(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def require_fields(rows: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rejects have a reason, the first required field that is null or blank."""
    reason = F.coalesce(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"no {n}")) for n, c in required.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def partition_by_freshness(items: DataFrame, *flags: str) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale); stale if any flag is."""
    s = is_stale(*map(F.col, flags))
    return items.where(~s), items.where(s)


def has_category(categories: Column, value: str) -> Column:
    return F.coalesce(F.array_contains(categories, value), F.lit(False))


def filter_condition(place: str = "", weekday: str = "", category: str = "", default_place: str | None = None, cols: tuple[str, str, str] = ("kommune", "weekday", "category_norm")) -> Column:
    """AND of the filters given. Blank is no filter; place None takes the default."""
    place = default_place or "" if place is None else place
    out = F.lit(True)
    if place:
        out = out & F.coalesce(F.col(cols[0]) == place, F.lit(False))
    if weekday:
        out = out & F.coalesce(F.col(cols[1]) == weekday, F.lit(False))
    return out & has_category(F.col(cols[2]), category) if category else out


def filter_listing(items: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
    """(items that pass, one row: visible, active)."""
    active = any(v for k, v in filters.items() if k in ("place", "weekday", "category"))
    seen = items.where(filter_condition(**filters))
    return seen, seen.agg(F.count("*").alias("visible")).withColumn("active", F.lit(active))


def prune_empty_groups(items: DataFrame, group: str, visible: Column, filtering: bool) -> DataFrame:
    """group, total, visible, hidden: a group is hidden if filtering leaves none of its items; one without items isn't. Null keys of `visible` count as items that aren't there."""
    g = items.groupBy(group).agg(F.count_if(visible.isNotNull()).alias("total"), F.count_if(F.coalesce(visible, F.lit(False))).alias("visible"))
    return g.withColumn("hidden", F.lit(filtering) & (F.col("total") > 0) & (F.col("visible") == 0))


def require_default_place(items: DataFrame, place: str, col: str = "kommune") -> DataFrame:
    """items; an error if no row has the place."""
    if items.where(F.col(col) == place).limit(1).isEmpty():
        raise ValueError(f"default place {place!r} isn't in the data")
    return items


def listing_for_dates(items: DataFrame, dates: DataFrame, place: str | None = None) -> DataFrame:
    """Dated and undated rows of fresh items: date (null for undated), occurrence and the item; with a place, only of that."""
    if place is not None:
        items = items.where(F.col("kommune") == place)
    dated, undated = expand_occurrences(items, dates)
    extra = undated.withColumn("date", F.lit(None).cast("date")).withColumn("occurrence", F.lit("undated"))
    return dated.unionByName(extra.select(*dated.columns))


def tonight(items: DataFrame, day: str, place: str | None = None) -> DataFrame:
    """What is on that day, and what has no date."""
    days = items.sparkSession.range(1).select(F.lit(day).cast("date").alias("date"))
    return listing_for_dates(items, days, place)


def week(items: DataFrame, day: str, days: int = 7, place: str | None = None) -> DataFrame:
    dates = items.sparkSession.range(days).select(F.date_add(F.lit(day).cast("date"), F.col("id").cast("int")).alias("date"))
    return listing_for_dates(items, dates, place)


def section_view(items: DataFrame, condition: Column, with_stale: bool) -> DataFrame:
    """Items of a place, county or venue with their section: dated, undated, or stale where the view shows those."""
    stale = is_stale(F.col("stale"))
    section = F.when(stale, F.lit("stale")).when(is_undated(F.col("weekday"), F.col("recurrence")), F.lit("undated")).otherwise(F.lit("dated"))
    out = items.where(condition).withColumn("section", section)
    return out if with_stale else out.where("section <> 'stale'")


# ---- counts and groups ----


def tally(df: DataFrame, col: str) -> DataFrame:
    """col, n with a place: count descending, then value. Nulls are a value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))


def count_by_category(items: DataFrame, col: str = "category_norm") -> DataFrame:
    """category, n; an item of several counts in each."""
    return items.select(F.explode(col).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def count_by_weekday(items: DataFrame, col: str = "weekday") -> DataFrame:
    """weekday, n, ord in week order, without nulls and empty days."""
    return items.where(F.col(col).isin(*WEEKDAYS)).groupBy(col).agg(F.count("*").alias("n")).withColumn("ord", F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.col(col)).cast("int"))


def group_sorted(items: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """key, items (array in the given order), sorted as Norwegians do. Collects a group's items: for listings that are shown."""
    g = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("_s"))
    return g.select(key, F.transform("_s", lambda s: s["_item"]).alias("items")).orderBy(collated(key))


def place_summary(items: DataFrame, place: str = "kommune", county: str = "county", order: str = "ord") -> DataFrame:
    """place, n, county of the first item by order."""
    return items.groupBy(place).agg(F.count("*").alias("n"), F.min_by(county, order).alias("county"))


def county_of(now: Column, source: Column) -> Column:
    return F.coalesce(now, source)


def former_regions(venues: DataFrame, now: str = "fylke_now", source: str = "fylke", place: str = "kommune") -> DataFrame:
    """county, former, places: names the source uses for part of a county; places only if the county also goes by its own name."""
    v = venues.select(county_of(F.col(now), F.col(source)).alias("county"), F.col(source).alias("former"), F.col(place).alias("place"))
    own = v.where("former = county").select("county").distinct().withColumn("_own", F.lit(True))
    g = v.where("former <> county").groupBy("county", "former").agg(F.array_sort(F.collect_set("place"), lambda a, b: F.when(F.collate(a, "nb") < F.collate(b, "nb"), -1).when(F.collate(a, "nb") > F.collate(b, "nb"), 1).otherwise(0)).alias("_p"))
    return g.join(own, "county", "left").select("county", "former", F.when(F.col("_own"), F.col("_p")).otherwise(F.array().cast("array<string>")).alias("places"))


def venues_per_region(venues: DataFrame, region: str = "kommune_nr") -> DataFrame:
    return venues.where(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("n"))


def normalize_stats(items: DataFrame) -> DataFrame:
    """One row: n_items, n_multi (several categories), n_with_address, n_without_time, and n_<kind>."""
    kinds = ("weekly", "biweekly", "monthly-nth", "last-of-month", "irregular")
    return items.agg(
        F.count("*").alias("n_items"), F.count_if(F.size("category_norm") > 1).alias("n_multi"), F.count_if(F.col("address_hint").isNotNull()).alias("n_with_address"),
        F.count_if(F.col("time").isNull()).alias("n_without_time"), *[F.count_if(F.col("recurrence.kind") == k).alias(f"n_{k.replace('-', '_')}") for k in kinds],
    )


def about_kpis(items: DataFrame) -> DataFrame:
    """One row of key figures over live items (venue_id, kommune, county, recurrence, weekday, time, category_norm, url, caveat)."""
    undated = is_undated(F.col("weekday"), F.col("recurrence"))
    return items.agg(
        F.count_distinct("venue_id").alias("n_venues"), F.count_distinct("kommune").alias("n_places"), F.count_distinct("county").alias("n_counties"),
        F.count_if(undated).alias("n_undated"), F.count_if(F.col("time").isNull()).alias("n_no_time"), F.count_if(F.size("category_norm") > 1).alias("n_multi"),
        F.count_distinct(F.when(F.col("url").isNotNull(), F.col("venue_id"))).alias("n_with_url"), F.count_if(F.col("caveat").isNotNull() & ~undated).alias("n_caveated"),
    )


def window_totals(dated: DataFrame, default_place: str, key: str = "id") -> DataFrame:
    """One row: total and total_default over dated rows; an item counts on each of its days."""
    return dated.agg(F.count(key).alias("total"), F.count_if((F.col("kommune") == default_place) & F.col(key).isNotNull()).alias("total_default"))


def stale_last_seen(items: DataFrame) -> DataFrame:
    return items.where(is_stale(F.col("stale"))).agg(F.max("last_seen").alias("last_seen"))


def places_overview(items: DataFrame) -> DataFrame:
    """county, place, n, n_county_venues (distinct venues of the county)."""
    by_place = items.groupBy("county", "kommune").agg(F.count("*").alias("n"))
    return by_place.join(items.groupBy("county").agg(F.count_distinct("venue_id").alias("n_county_venues")), "county")


def upcoming_days(dated: DataFrame) -> DataFrame:
    """venue_id, date, n of days on which a venue has something."""
    return dated.where("venue_id is not null").groupBy("venue_id", "date").agg(F.count("*").alias("n"))


def venue_items(venues: DataFrame, items: DataFrame, key: str = "venue_id") -> DataFrame:
    """Every venue, with its items or none."""
    return venues.join(items, key, "left")


def data_credits(venues: DataFrame, credits: dict[str, tuple[str, ...]] = CREDITS, order: tuple[str, ...] = CREDIT_ORDER) -> tuple[DataFrame, DataFrame]:
    """(credit, ord) owed for the sources of venues that have coordinates, and the sources that no credit is known for."""
    used = venues.where("lat is not null and lon is not null and geo_source is not null").select("geo_source").distinct()
    rows = [(s, c, order.index(c)) for s, owed in credits.items() for c in owed]
    dim = venues.sparkSession.createDataFrame(rows, "geo_source string, credit string, ord int")
    return used.join(F.broadcast(dim), "geo_source").select("credit", "ord").distinct(), used.where(~F.col("geo_source").isin(*credits))
