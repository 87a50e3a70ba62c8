"""Free-text recurrence to a closed set of rules. Where the text leaves doubt, the kind is irregular."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, compact_folded, compacted_words, js_pattern, let, lower_fold

# ---- fixed values ----
WEEKDAYS = ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lordag", "sondag")
BYDAY = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
_STEMS = ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "(?:lordag|lørdag)", "(?:sondag|søndag)")
ORDINALS = {1: r"\b(?:forste|første|1|1\.|1st)\b", 2: r"\b(?:andre|annen|2|2\.)\b", 3: r"\b(?:tredje|3|3\.)\b", 4: r"\b(?:fjerde|4|4\.)\b"}
LAST_OF_MONTH = r"\bsiste\b|\bsist\s+i\b|\bsent\s+i\s+(?:mnd|maneden|måneden)\b"
MONTH = r"\b(?:mnd|md|maned|måned|maneden|måneden|manedlig|månedlig)\b"
EVERY_NTH = r"\bhver\s+(?:forste|første|andre|tredje|fjerde|femte)\b"
AMBIGUOUS = r"\bvarierer\b|\bvarierende\b|\butvalgte\b|\buregelmessig\b|\bsporadisk\b|\bav\s+og\s+til\b|\bved\s+behov\b|\better\s+avtale\b|\bikke\s+fast\b|\bdiverse\b"
ALTERNATIVE = r"\beller\b|\bevt\.?\b|\beventuelt\b"
BIWEEKLY_WORDS = ("annenhver", "annen hver", "hver andre", "hveranden", "oddetallsuke", "partallsuke")
ODD_WORDS = ("oddetallsuker", "oddetallsuke", "ulike uker", "ulik uke", "odde uker", "odde uke")
EVEN_WORDS = ("partallsuker", "partallsuke", "like uker", "like uke", "jevne uker", "jevne uke")
# ---- end of fixed values ----

RECURRENCE = "struct<kind:string,rrule:string,raw:string,week_parity:string,bysetpos:array<int>>"


def _has(t: Column, pattern: str) -> Column:
    return t.rlike(js_pattern(pattern))


def find_weekdays(t: Column) -> Column:
    """Weekdays named in folded text, Monday first."""
    # The look ahead is for speed only.
    named = F.regexp_extract_all(t, F.lit(js_pattern(rf"(?=[mtofls])\b({'|'.join(_STEMS)})(?:er|en|ene)?\b")), F.lit(1))
    return let(F.transform(named, lambda x: F.translate(x, "ø", "o")), lambda found: F.filter(F.array(*map(F.lit, WEEKDAYS)), lambda d: F.array_contains(found, d)))


def parse_weekday(c: Column) -> Column:
    """The weekday if the text names exactly one, else null."""
    days = find_weekdays(lower_fold(c))
    return F.when(F.size(days) == 1, F.get(days, F.lit(0)))


def find_ordinals(t: Column) -> Column:
    """Positions within the month that folded text names, ascending; dates like 3/4 don't count."""
    t = F.regexp_replace(t, js_pattern(r"[0-9]{1,2}\s*[/.]\s*[0-9]{1,2}"), " ")
    return let(t, lambda t: F.array_compact(F.array(*[F.when(_has(t, p), F.lit(k)) for k, p in ORDINALS.items()])))


def _parity(compacted: Column) -> Column:
    return F.when(compacted.rlike(compacted_words(ODD_WORDS)), F.lit("odd")).when(compacted.rlike(compacted_words(EVEN_WORDS)), F.lit("even"))


def week_parity(c: Column) -> Column:
    """odd, even or null. Odd is tried first, for its compacted words hold those of even."""
    return let(compact(c), _parity)


def build_rule(freq: Column, day: Column, interval: Column | None = None, setpos: Column | None = None) -> Column:
    """FREQ, BYDAY, then INTERVAL or BYSETPOS where given (null leaves it out). day is a weekday name."""
    code = F.get(F.array(*map(F.lit, BYDAY)), F.array_position(F.array(*map(F.lit, WEEKDAYS)), day) - 1)
    parts = [F.concat(F.lit("FREQ="), freq), F.concat(F.lit("BYDAY="), code)]
    if interval is not None:
        parts.append(F.concat(F.lit("INTERVAL="), interval.cast("string")))
    if setpos is not None:
        parts.append(F.concat(F.lit("BYSETPOS="), F.array_join(setpos.cast("array<string>"), ",")))
    return F.concat_ws(";", *parts)


def parse_recurrence(c: Column) -> Column:
    """struct(kind, rrule, raw, week_parity, bysetpos). The first test that applies decides; raw is the text as it came, null stays null.

    What the tests look at is computed once for each text.
    """
    read = lambda t: F.struct(find_weekdays(t).alias("days"), find_ordinals(t).alias("ordinals"), _has(t, MONTH).alias("month"), compact_folded(t).alias("compacted"), t.alias("t"))
    return F.when(c.isNull(), F.lit(None)).otherwise(let(lower_fold(c), lambda t: let(read(t), lambda x: _decide(c, x))))


def _decide(c: Column, x: Column) -> Column:
    t, ordinals, month, day = x["t"], x["ordinals"], x["month"], F.get(x["days"], F.lit(0))
    last, none = F.array(F.lit(-1)), F.lit(None)

    def rule(kind: str, rrule: Column, parity: Column = none, setpos: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), rrule.cast("string").alias("rrule"), c.alias("raw"), parity.cast("string").alias("week_parity"), setpos.cast("array<int>").alias("bysetpos"))

    irregular = rule("irregular", none)
    monthly, weekly = F.lit("MONTHLY"), F.lit("WEEKLY")
    some = F.size(ordinals) > 0
    return (
        F.when((F.size(x["days"]) != 1) | _has(t, AMBIGUOUS), irregular)
        .when(_has(t, LAST_OF_MONTH), rule("last-of-month", build_rule(monthly, day, setpos=last), setpos=last))
        .when(x["compacted"].rlike(compacted_words(BIWEEKLY_WORDS)) & ~(month & some), rule("biweekly", build_rule(weekly, day, F.lit(2)), _parity(x["compacted"])))
        .when(month & some, rule("monthly-nth", build_rule(monthly, day, setpos=ordinals), setpos=ordinals))
        .when(month | _has(t, EVERY_NTH) | _has(t, ALTERNATIVE), irregular)
        .otherwise(rule("weekly", build_rule(weekly, day)))
    )
