"""Civil dates, and whether a recurring event falls on one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recurrence import WEEKDAYS
from .text import js_pattern

# ---- fixed values ----
ZONE = "Europe/Oslo"
CAVEAT = r"(?i)\b(ikke|unntatt|utenom|vanligvis|som regel|av og til|sjelden|foreløpig|omtrent|cirka|ca\.)\b|\b(sent|tidlig) i\b|sesong|sporadisk"
CATEGORY_CAVEAT = r"(?i)\b(gang|ganger|gonger)\s+(i|per)\s+(måneden|månaden|måned|månad)\b|\bmånedlig\b|\bmånadleg\b|sporadisk|\b(noen|nokre)\s+unntak\b|\bsjekk\s+programmet\b"
BADGE_BIWEEKLY, BADGE_CHECK = "annenhver uke", "sjekk selv"
# ---- end of fixed values ----


def _local(ts: Column, zone: str) -> Column:
    """UTC instant (timestamp_ntz) to local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(_local(ts, zone))


def local_time(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(_local(ts, zone), "HH:mm")


def weekday_of(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d))


def local_weekday(ts: Column, zone: str = ZONE) -> Column:
    return weekday_of(local_date(ts, zone))


def civil_date(c: Column) -> Column:
    """Text to date; anything but YYYY-MM-DD is an error, null stays null."""
    return F.when(c.isNull(), F.lit(None).cast("date")).when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(c)).otherwise(F.raise_error(F.concat(F.lit("not a civil date: "), c)).cast("date"))


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)


def week_window(d: Column, days: int = 7) -> Column:
    """The dates of n days from d on."""
    return F.sequence(d, F.date_add(d, days - 1))


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def date_parts(d: Column) -> Column:
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"))


def is_undated(weekday: Column, rule: Column) -> Column:
    """Irregular, without a weekday, or monthly without a rule."""
    plain = rule["kind"].isin("weekly", "biweekly")
    return (rule["kind"] == "irregular") | weekday.isNull() | (~plain & rule["rrule"].isNull())


def has_caveat(c: Column) -> Column:
    return F.coalesce(c.rlike(js_pattern(CAVEAT)), F.lit(False))


def has_category_caveat(c: Column) -> Column:
    return F.coalesce(c.rlike(js_pattern(CATEGORY_CAVEAT)), F.lit(False))


def caveat_of(raw: Column, category: Column) -> Column:
    """struct(text, field) of the first field that hedges, else null."""
    pair = lambda c, f: F.struct(c.alias("text"), F.lit(f).alias("field"))
    return F.when(has_caveat(raw), pair(raw, "raw")).when(has_category_caveat(category), pair(category, "category"))


def matches_monthly_rule(setpos: Column, d: Column) -> Column:
    """d, which has the rule's weekday, is at one of the positions among that weekday in its month; -1 is the last."""
    return F.array_contains(setpos, F.ceil(F.day(d) / 7).cast("int")) | (F.array_contains(setpos, F.lit(-1)) & (F.date_add(d, 7) > F.last_day(d)))


def occurrence_on(weekday: Column, rule: Column, category: Column, d: Column) -> Column:
    """certain, likely, no or undated. A caveat turns certain into likely and nothing else."""
    same = weekday_of(d) == weekday
    odd = (iso_week(d) % 2) == 1
    sure = F.when(caveat_of(rule["raw"], category).isNotNull(), F.lit("likely")).otherwise(F.lit("certain"))
    return (
        F.when(is_undated(weekday, rule), F.lit("undated"))
        .when(~same, F.lit("no"))
        .when(rule["kind"] == "weekly", sure)
        .when((rule["kind"] == "biweekly") & rule["week_parity"].isNull(), F.lit("likely"))
        .when(rule["kind"] == "biweekly", F.when(odd == (rule["week_parity"] == "odd"), sure).otherwise(F.lit("no")))
        .when(matches_monthly_rule(rule["bysetpos"], d), sure)
        .otherwise(F.lit("no"))
    )


def occurs_on(weekday: Column, rule: Column, category: Column, d: Column) -> Column:
    return occurrence_on(weekday, rule, category, d).isin("certain", "likely")


def expand_occurrences(items: DataFrame, dates: DataFrame, weekday: str = "weekday", rule: str = "recurrence", category: str = "category") -> tuple[DataFrame, DataFrame]:
    """(dated, undated): items on the dates (column date) on which they occur, with `occurrence`, and the items without a date.

    Every date keeps a row, with null item columns if nothing is on. Items meet dates by an equi-join on the weekday, so that
    six of seven pairs are never made.
    """
    undated = items.where(is_undated(F.col(weekday), F.col(rule)))
    days = dates.select("date").distinct().withColumn("_day", weekday_of(F.col("date")))
    can = items.where(~is_undated(F.col(weekday), F.col(rule)))
    met = can.join(days, can[weekday] == days["_day"]).withColumn("occurrence", occurrence_on(F.col(weekday), F.col(rule), F.col(category), F.col("date"))).where("occurrence <> 'no'").drop("_day")
    return dates.select("date").distinct().join(met, "date", "left"), undated


def card_status(weekday: Column, rule: Column, category: Column, d: Column | None = None) -> Column:
    """struct(status, badge, badge_reason, quoted_text) of a listed item, on a date or in general."""
    status = F.when(is_undated(weekday, rule), F.lit("undated")).otherwise(F.lit("certain") if d is None else occurrence_on(weekday, rule, category, d))
    likely, two = status == "likely", rule["kind"] == "biweekly"
    caveat = F.when(likely & ~two, caveat_of(rule["raw"], category))
    badge = F.when(likely, F.when(two, F.lit(BADGE_BIWEEKLY)).otherwise(F.lit(BADGE_CHECK)))
    quoted = F.when(status == "undated", rule["raw"]).otherwise(caveat["text"])
    return F.struct(status.alias("status"), badge.alias("badge"), caveat["field"].alias("badge_reason"), quoted.alias("quoted_text"))
