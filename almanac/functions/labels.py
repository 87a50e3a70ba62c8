"""Display text, links and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import local_date, local_time, weekday_of
from .recurrence import WEEKDAYS
from .text import js_trim, lookup

# ---- fixed values ----
WEEKDAY_LABELS = dict(zip(WEEKDAYS, ("Mandag", "Tirsdag", "Onsdag", "Torsdag", "Fredag", "Lørdag", "Søndag"), strict=True))
CATEGORY_LABELS = {"allmenn": "Allmenn", "musikk": "Musikk", "sport": "Sport", "film": "Film", "annet": "Annet"}
MONTHS = ("januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember")
UNKNOWN_TIME = "Tidspunkt ikke oppgitt"
TONIGHT, TOMORROW = "I kveld", "I morgen"
# ---- end of fixed values ----


def weekday_label(c: Column) -> Column:
    return lookup(c, WEEKDAY_LABELS)


def category_label(c: Column) -> Column:
    return lookup(c, CATEGORY_LABELS)


def join_words(words: Column) -> Column:
    """A, B og C; empty for none."""
    n = F.size(words)
    return F.when(n <= 1, F.coalesce(F.get(words, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" og "), F.element_at(words, F.when(n > 0, F.lit(-1)).otherwise(F.lit(1)))))


def category_list(categories: Column) -> Column:
    """Labels of which only the first is capitalised."""
    return join_words(F.transform(categories, lambda c, i: F.when(i == 0, category_label(c)).otherwise(F.lower(category_label(c)))))


def collapse_former_names(names: Column) -> Column:
    return join_words(names)


def time_label(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNKNOWN_TIME))


def _month(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1)


def long_date(d: Column) -> Column:
    return F.concat(F.day(d).cast("string"), F.lit(". "), _month(d), F.lit(" "), F.year(d).cast("string"))


def day_heading(d: Column, today: Column) -> Column:
    plain = F.concat(weekday_label(weekday_of(d)), F.lit(" "), F.day(d).cast("string"), F.lit(". "), _month(d))
    return F.when(d == today, F.lit(TONIGHT)).when(d == F.date_add(today, 1), F.lit(TOMORROW)).otherwise(plain)


def timestamp_label(ts: Column) -> Column:
    """A UTC instant in local words."""
    return F.concat(long_date(local_date(ts)), F.lit(" kl. "), local_time(ts))


def recurrence_label(kind: Column, raw: Column, weekday: Column) -> Column:
    """Irregular and monthly-nth keep the source's words."""
    day = F.lower(weekday_label(weekday))
    either = lambda with_day, without: F.when(day.isNotNull(), with_day).otherwise(F.lit(without))
    return (
        F.when(kind == "weekly", either(F.concat(F.lit("Hver "), day), "Ukentlig"))
        .when(kind == "biweekly", either(F.concat(F.lit("Annenhver "), day), "Annenhver uke"))
        .when(kind == "last-of-month", either(F.concat(F.lit("Siste "), day, F.lit(" i måneden")), "Siste i måneden"))
        .otherwise(raw)
    )


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def event_count(n: Column) -> Column:
    return _plural(n, "1 quiz", "quizer")


def venue_count(n: Column) -> Column:
    return _plural(n, "1 sted", "steder")


def report_link(email: Column, subject: Column, body: Column) -> Column:
    """mailto: with percent-encoded subject and body."""
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("mailto:"), email, F.lit("?subject="), code(subject), F.lit("&body="), code(body))


def _segments(parts: tuple[Column, ...]) -> Column:
    return F.filter(F.transform(F.split(F.concat_ws("/", *parts), "/"), js_trim), lambda s: s != "")


def join_path(*parts: Column) -> Column:
    """Segments between single slashes, one in front and one at the end."""
    s = F.array_join(_segments(parts), "/")
    return F.when(s == "", F.lit("/")).otherwise(F.concat(F.lit("/"), s, F.lit("/")))


def asset_path(*parts: Column) -> Column:
    """Like join_path, without the last slash."""
    return F.concat(F.lit("/"), F.array_join(_segments(parts), "/"))
