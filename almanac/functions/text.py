"""Column expressions that normalise volunteer-written text. Nulls give nulls unless stated."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word border as ECMAScript has them; Java's own \s and \b differ.
WS = r"[\t-\r    -     　﻿]"
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# ---- fixed values ----
TRANSLITERATED = {"æ": "ae", "ø": "oe", "å": "aa", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
TRANSLITERATED_SLUG = TRANSLITERATED | {"đ": "d", "ð": "d", "þ": "th"}
STREET_SUFFIX = "(?:vei|veien|vn|gate|gaten|gata|gt|plass|plassen|alle|allé|alléen|alleen|torg|torget|brygge|brygga|kai|kaia|plassen|stredet|bakken|svingen|løkka|lokka)"
ADDRESS = rf"\b([A-ZÆØÅ][\wÆØÅæøå'\-]*{STREET_SUFFIX}|[A-ZÆØÅ][\wÆØÅæøå'\-]+)\s+(\d{{1,4}}\s*[A-Za-z]?)\b"
STRICT_ADDRESS = rf"\b([A-ZÆØÅ][\wÆØÅæøå'\-]*{STREET_SUFFIX})\s+(\d{{1,4}}\s*[A-Za-z]?)\b"
TIDY_START, TIDY_END, TIDY_CLOSE = r"^[\s,;:.)\]»]+", r"[\s,;:.(\[«]+$", r"\)+$"
LABEL_RULES = {
    "allmenn": r"\ballmenn\w*\b|\bgenerell\b|\bblandet\b|\bvariert\b",
    "musikk": r"\bmusikk\w*\b|\brock\w*\b|\bpop\b|\bpopkultur\b|\bmusikkbingo\b|\bhiphop\b|\bjazz\b|\blyd\b",
    "sport": r"\bsport\w*\b|\bfotball\w*\b|\bidrett\w*\b",
    "film": r"\bfilm\w*\b|\bkino\b|\btv-?serie\w*\b|\bserier\b",
}
DEFAULT_LABEL = "annet"
NOISE_WORDS = ("the", "den", "det", "og", "and", "as", "a/s", "ans", "avd", "avdeling")
GENERIC_WORDS = (
    "pub", "bar", "kro", "kafe", "cafe", "kaffe", "kaffebar", "restaurant", "pizzeria", "gjestgiveri", "hotell", "hotel", "scene",
    "klubb", "club", "lounge", "bistro", "brasserie", "bryggeri", "brewery", "taproom", "sportsbar", "nattklubb", "spiseri", "vinbar",
)
REGION_NUMBERS = {
    "Oslo": "03", "Rogaland": "11", "Møre og Romsdal": "15", "Nordland": "18", "Østfold": "31", "Akershus": "32", "Buskerud": "33",
    "Hedmark": "34", "Oppland": "34", "Vestfold": "39", "Telemark": "40", "Aust-Agder": "42", "Vest-Agder": "42", "Hordaland": "46",
    "Sogn og Fjordane": "46", "Sør-Trøndelag": "50", "Nord-Trøndelag": "50", "Troms": "55", "Finnmark": "56", "Svalbard": None,
}
PLACE_RANKS = {
    "By": 100, "Tettsted": 95, "Tettbebyggelse": 90, "Bydel": 85, "Del av by": 80, "Sokn": 75, "Annen administrativ inndeling": 70,
    "Grend": 60, "Bygdelag (bygd)": 58, "Bygd": 55, "Boligfelt": 50, "Kommune": 45, "Stasjon": 30, "Kirke": 25, "Flyplass": 20,
    "Øy": 15, "Gard": 2, "Navnegard": 1,
}
DEFAULT_PLACE_RANK = 35
NO_WEEKDAY, NO_TIME, NO_VENUE, NO_EVENT = "ukjent", "natid", "ukjent-sted", "ukjent-quiz"
# ---- end of fixed values ----


def js_pattern(pattern: str) -> str:
    """A pattern with ECMAScript's \\b, \\s and $ for Spark: a class within a class is a part of it, and $ at the end isn't before a last line end."""
    return re.sub(r"(?<!\\)\$$", r"\\z", pattern.replace(r"\b", BORDER).replace(r"\s", WS))


def _folds() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with marks, and those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x2000)]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].islower() and all(0x300 <= ord(x) <= 0x36F for x in d[1:])]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_FROM, _TO = _folds()


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def _ascii(c: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[̀-ͯ]", "")


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by single dashes; may be empty."""
    return F.regexp_replace(F.regexp_replace(_ascii(F.lower(c), TRANSLITERATED_SLUG), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def venue_id(place: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(slug(F.concat(place, F.lit("-"), name)), F.lit("")), F.lit(NO_VENUE))


def event_id(place: Column, name: Column, weekday: Column, time: Column) -> Column:
    """Null weekday and time have words of their own in the id."""
    parts = F.concat_ws("-", place, name, F.coalesce(weekday, F.lit(NO_WEEKDAY)), F.coalesce(time, F.lit(NO_TIME)))
    return F.coalesce(F.nullif(slug(parts), F.lit("")), F.lit(NO_EVENT))


def normalize_time(c: Column) -> Column:
    """HH:MM from the first H:MM or H.MM, else from a bare hour; null if there is none or it can't be."""
    t = collapse(c)
    h, m = (F.regexp_extract(t, rf"([0-9]{{1,2}}){WS}*[:.]{WS}*([0-9]{{2}})", k) for k in (1, 2))
    hour = F.regexp_extract(t, rf"^(?:kl\.?{WS}*)?([0-9]{{1,2}})$", 1)
    clock = lambda x, y: F.when((x.cast("int") < 24) & (y.cast("int") < 60), F.concat(F.lpad(x, 2, "0"), F.lit(":"), y))
    return F.when(h != "", clock(h, m)).when(hour != "", clock(hour, F.lit("00")))


def _tidy_address(c: Column) -> Column:
    c = collapse(c)
    for p in (TIDY_START, TIDY_END, TIDY_CLOSE):
        c = F.regexp_replace(c, js_pattern(p), "")
    return js_trim(c)


def clean_venue(c: Column, addresses: tuple[str, str] = (STRICT_ADDRESS, ADDRESS)) -> Column:
    """struct(name, address_hint): an address after the first line, in a closing parenthesis or behind the name is set apart.

    addresses: what an address is by its street's ending, which is looked for first and alone behind a name, and what else is
    one. By default house numbers have four digits at most.
    """
    strict, loose = map(js_pattern, addresses)
    lines = F.filter(F.transform(F.split(c, "\n"), js_trim), lambda x: x != "")
    many = F.size(lines) > 1
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    inside = rf"^(.*?){WS}*\(([^()]*)\){WS}*$"
    before = js_trim(F.regexp_extract(first, inside, 1))
    head = F.when(many | (before == ""), first).otherwise(before)
    tail = F.when(many, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ", ")).when(before != "", js_trim(F.regexp_extract(first, inside, 2)))
    wrapped = js_trim(tail)
    candidate = collapse(F.when(wrapped.rlike(r"^\(.*\)$"), F.regexp_extract(wrapped, r"^\((.*)\)$", 1)).otherwise(wrapped))
    found = F.coalesce(*[F.nullif(F.regexp_extract(candidate, f"(?s){p}.*", 0), F.lit("")) for p in (strict, loose)])
    hint = F.nullif(_tidy_address(found), F.lit(""))
    name = F.coalesce(F.nullif(collapse(head), F.lit("")), collapse(c))
    bare = F.regexp_replace(js_trim(F.regexp_extract(name, f"(?s)^(.+?){strict}", 1)), rf"[,\-–]{WS}*$", "")
    own = F.nullif(_tidy_address(F.regexp_extract(name, strict, 0)), F.lit(""))
    starts = name.rlike(f"^{strict}")
    cut = tail.isNull() & ~starts & (F.length(bare) > 1) & own.isNotNull()
    pair = lambda n, h: F.struct(n.alias("name"), h.alias("address_hint"))
    none = F.lit(None).cast("string")
    return F.when(c.isNull(), F.lit(None)).when(tail.isNotNull() & hint.isNotNull(), pair(name, hint)).when(tail.isNotNull(), pair(collapse(c), none)).when(cut, pair(bare, own)).otherwise(pair(name, none))


def clean_category(c: Column) -> Column:
    """Line ends become ` / `; white space collapsed."""
    return collapse(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), f"{WS}*\n{WS}*", " / "))


def classify_labels(c: Column, rules: dict[str, str] = LABEL_RULES, default: str = DEFAULT_LABEL) -> Column:
    """All labels whose rule matches, in the order of rules; the default alone if none does, or for null."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "[«»\"'”“]", " "), r"[‐-―]", "-")
    t = collapse(t)
    found = F.array_compact(F.array(*[F.when(t.rlike(js_pattern(p)), F.lit(name)) for name, p in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def primary_label(c: Column, rules: dict[str, str] = LABEL_RULES, default: str = DEFAULT_LABEL) -> Column:
    return F.get(classify_labels(c, rules, default), F.lit(0))


def lower_fold(c: Column) -> Column:
    """Lower case, dashes of any length alike, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"[‐-―]", "-"))


def compact_folded(t: Column) -> Column:
    """compact() of text that lower_fold() made."""
    return F.regexp_replace(F.regexp_replace(t, rf"(?:{WS}|[\-.,()])+", ""), r"(?s)(.)\1+", "$1")


def compact(c: Column) -> Column:
    """lower_fold without white space and - . , ( ), runs of a character shortened to one."""
    return compact_folded(lower_fold(c))


def compacted_words(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, each made as compact() does."""
    return "|".join(re.escape(re.sub(r"(?s)(.)\1+", r"\1", re.sub(r"[\s\-\u2010-\u2015.,()]+", "", w.lower()))) for w in words)


def contains_compacted(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the compacted text holds one of the words, compacted alike."""
    return compact(c).rlike(compacted_words(words))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_place_qualifier(c: Column) -> Column:
    """Without a trailing ` i Somewhere` and ` kommune`."""
    c = F.regexp_replace(js_trim(c), rf"{WS}+i{WS}+[A-ZÆØÅ][^{WS[1:-1]}]*$", "")
    return js_trim(F.regexp_replace(c, rf"(?i){WS}+kommune$", ""))


def normalize_place(c: Column) -> Column:
    return slug(strip_place_qualifier(c))


def lookup(c: Column, table: dict, default=None) -> Column:
    """The value of a small fixed table for c, else the default; branches, so that it stays one expression."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def region_number(c: Column) -> Column:
    """Current number of a region by its former name; null if unknown or without one."""
    return lookup(js_trim(c), REGION_NUMBERS)


def place_rank(c: Column) -> Column:
    return lookup(c, PLACE_RANKS, DEFAULT_PLACE_RANK)


def normalize_name(c: Column) -> Column:
    """Lower-case ASCII words of a venue name, without quotes and parentheses; & is og."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "[«»\"”“'’`]", " "), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.replace(_ascii(t, TRANSLITERATED), F.lit("&"), F.lit(" og ")), "[^a-z0-9]+", " "))


def name_tokens(c: Column, drop_generic: bool = False, normalized: bool = False) -> Column:
    """Words of a name without noise words and single characters, repeats kept."""
    drop = [*NOISE_WORDS, *(GENERIC_WORDS if drop_generic else ())]
    return F.filter(F.split(c if normalized else normalize_name(c), " "), lambda w: (F.length(w) > 1) & ~w.isin(drop))
