"""Validation against declared rules, and audits that return what breaks an invariant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calendar import has_caveat, is_undated, occurs_on
from ..functions.recurrence import WEEKDAYS
from ..functions.text import js_pattern, js_trim

# ---- fixed values ----
GEO_SOURCES = ("address", "osm", "kartverket", "centroid", "manual")
CONFIDENCES = ("high", "medium", "low")
PARITIES = ("odd", "even")
KINDS = ("weekly", "biweekly", "monthly-nth", "last-of-month", "irregular")
CATEGORIES = ("allmenn", "musikk", "sport", "film", "annet")
TIME = r"^([01]\d|2[0-3]):[0-5]\d$"
REGION_NUMBER = r"^\d{4}$"
BARE_WEEKDAY = "^(mandag|tirsdag|onsdag|torsdag|fredag|lørdag|søndag)(er)?$"
# ---- end of fixed values ----

@dataclass(frozen=True)
class Field:
    """A field of a schema by its path. required: not null; nullable: there, but maybe null; optional: may be missing.

    In a table a field is there if its column is. holds is tested where the value isn't null.
    """

    path: str
    kind: str = "required"
    holds: Callable[[Column], Column] | None = None


def _is(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(js_pattern(pattern))


_SOME = lambda c: F.length(c) > 0
_IN = lambda values: lambda c: c.isin(*values)
_WITHIN = lambda least, most: lambda c: c.between(least, most)
VENUE = (
    Field("id", holds=_SOME), Field("name", holds=_SOME), Field("raw_name"), Field("address_hint", "optional"), Field("kommune", holds=_SOME), Field("fylke", holds=_SOME),
    Field("kommune_nr", "optional", _is(REGION_NUMBER)), Field("kommune_name", "optional", _SOME), Field("fylke_now", "optional", _SOME), Field("lat", "optional", _WITHIN(-90, 90)), Field("lon", "optional", _WITHIN(-180, 180)),
    Field("geo_source", "optional", _IN(GEO_SOURCES)), Field("geo_confidence", "optional", _IN(CONFIDENCES)), Field("url", "optional"), Field("url_broken", "optional"), Field("stale", "optional"),
)
EVENT = (
    Field("id", holds=_SOME), Field("venue_id", holds=_SOME), Field("weekday", "nullable", _IN(WEEKDAYS)), Field("time", "nullable", _is(TIME)), Field("recurrence"), Field("recurrence.kind", holds=_IN(KINDS)), Field("recurrence.rrule", "optional"),
    Field("recurrence.raw"), Field("recurrence.week_parity", "optional", _IN(PARITIES)), Field("category"), Field("category_norm", holds=lambda c: (F.size(c) > 0) & F.coalesce(F.forall(c, lambda x: F.coalesce(x.isin(*CATEGORIES), F.lit(False))), F.lit(False))),
    Field("note", "optional"), Field("last_seen"), Field("stale", "optional"),
)


def _there(schema: StructType, path: str) -> bool:
    """Whether a schema has a path; names count as Spark compares them."""
    for name in path.split("."):
        found = next((f for f in getattr(schema, "fields", ()) if f.name.lower() == name.lower()), None)
        if found is None:
            return False
        schema = found.dataType
    return True


def schema_rules(df: DataFrame, fields: tuple[Field, ...]) -> dict[str, Column]:
    """Rules for validate(). A path below a null struct breaks no rule of its own; that of the struct says it. A missing column that isn't optional breaks its rule in every row."""
    rules = {}
    for f in fields:
        above = f.path.rpartition(".")[0]
        if not _there(df.schema, f.path):
            if f.kind != "optional" and (not above or _there(df.schema, above)):
                rules[f.path] = F.lit(False)
            continue
        c = F.col(f.path)
        ok = F.coalesce(f.holds(c), F.lit(False)) if f.holds else F.lit(True)
        ok = F.when(c.isNull(), F.lit(f.kind != "required")).otherwise(ok)
        rules[f.path] = F.when(F.col(above).isNull(), F.lit(True)).otherwise(ok) if above else ok
    return rules


def validate(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, path of every rule a row breaks; a rule that is null for a row passes (those of schema_rules() never are)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(path)) for path, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("path"))


def first_issues(violations: DataFrame, n: int = 10) -> list[str]:
    """The first n violations by path and key, as `path: key`."""
    key = next(c for c in violations.columns if c != "path")
    return [f"{r['path']}: {r[key]}" for r in violations.orderBy("path", key).limit(n).collect()]


def conservation_audit(items: DataFrame, dated: DataFrame, undated: DataFrame, key: str = "id") -> DataFrame:
    """key, problem: items that are in neither part, or in both."""
    d, u = dated.select(key).distinct(), undated.select(key).distinct()
    lost = items.select(key).join(d, key, "left_anti").join(u, key, "left_anti").withColumn("problem", F.lit("lost"))
    return lost.unionByName(d.join(u, key).withColumn("problem", F.lit("both")))


def reachability_audit(items: DataFrame, start: Column, horizon: int = 35, key: str = "id") -> DataFrame:
    """Datable items with no day within the horizon. Days are tested within the row, so nothing is multiplied or shuffled."""
    days = F.sequence(start, F.date_add(start, horizon - 1))
    on = F.exists(days, lambda d: occurs_on(F.col("weekday"), F.col("recurrence"), F.col("category"), d))
    return items.where(~is_undated(F.col("weekday"), F.col("recurrence")) & ~on).select(key)


def unexplained_weekly_audit(items: DataFrame, reviewed: DataFrame, key: str = "id") -> DataFrame:
    """key, problem: dated weekly items whose text is more than a weekday (a year, a season, another form of the word), hedges nothing and isn't reviewed; and reviewed keys that are gone."""
    bare = js_trim(F.col("recurrence.raw")).rlike(f"(?iu){BARE_WEEKDAY}")
    weekly = (F.col("recurrence.kind") == "weekly") & ~is_undated(F.col("weekday"), F.col("recurrence"))
    odd = items.where(weekly & ~bare & ~has_caveat(F.col("recurrence.raw"))).select(key)
    open_ = odd.join(reviewed.select(key), key, "left_anti").withColumn("problem", F.lit("unexplained"))
    return open_.unionByName(reviewed.select(key).join(items.select(key), key, "left_anti").withColumn("problem", F.lit("gone")))


def caveat_share_audit(items: DataFrame, most: float = 0.1) -> DataFrame:
    """One row: share of caveats among datable items, ok."""
    dated = items.where(~is_undated(F.col("weekday"), F.col("recurrence")))
    return dated.agg(F.coalesce(F.avg(F.col("caveat").isNotNull().cast("int")), F.lit(0.0)).alias("share")).withColumn("ok", F.col("share") <= most)


def navigation_audit(venues: DataFrame, pages: DataFrame, former: DataFrame) -> DataFrame:
    """name, problem: counties of venues without a page, pages that no venue belongs to, and former names that `former` doesn't mention."""
    county = F.coalesce("fylke_now", "fylke")
    used = venues.select(county.alias("name")).distinct()
    lacking = used.join(pages.select(F.col("county").alias("name")), "name", "left_anti").withColumn("problem", F.lit("no page"))
    dead = pages.select(F.col("county").alias("name")).join(used, "name", "left_anti").withColumn("problem", F.lit("dead page"))
    old = venues.where(F.col("fylke") != county).select(F.col("fylke").alias("name")).distinct()
    silent = old.join(former.select(F.col("former").alias("name")), "name", "left_anti").withColumn("problem", F.lit("not mentioned"))
    return lacking.unionByName(dead).unionByName(silent)


def override_policy_audit(patch: DataFrame, forbidden: tuple[str, ...] = ("recurrence", "weekday", "time"), set_fields: str = "set_fields", key: str = "id") -> DataFrame:
    """key, field of patches that claim a schedule."""
    return patch.select(key, F.explode(set_fields).alias("field")).where(F.col("field").isin(*forbidden))
