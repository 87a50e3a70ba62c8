"""Fuzzy matching of venue names with map objects, by expressions inside a blocked join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERIC_WORDS, NOISE_WORDS, let, name_tokens, normalize_name
from ..sources.paths import stored
from .geo import distance_m

# ---- fixed values ----
FUZZY, CORE_FUZZY = 0.82, 0.9
EXACT_SCORES = (1.0, 0.98, 0.97)
STRONG_SCORE, PLACE_DICE, PLACE_LENGTH, SHARED_LENGTH = 0.9, 0.85, 5, 4
SAME_PLACE_M, NEAR_SCORE = 250, 0.02
KIND_RANK = {"exact": 3, "strong": 2, "fuzzy": 1}
# ---- end of fixed values ----


def bigrams(c: Column) -> Column:
    """All pairs of neighbouring characters, repeats kept."""
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def numbered(grams: Column) -> Column:
    """A multiset as a set, sorted: each gram with its place among equal ones, from 1. Sets of two texts have as many members in common as their multisets."""
    return let(F.sort_array(grams), lambda s: F.transform(s, lambda g, i: F.concat(g, (i + 2 - F.array_position(s, g)).cast("string"))))


def dice(a: Column, b: Column, grams_a: Column | None = None, grams_b: Column | None = None) -> Column:
    """Sorensen-Dice over bigram multisets (numbered(), where they are given); 1 for equal texts, else 0 if one has fewer than two characters."""
    x, y = (numbered(bigrams(a)) if grams_a is None else grams_a), (numbered(bigrams(b)) if grams_b is None else grams_b)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def is_place_word(word: Column, place_tokens: Column) -> Column:
    """Generic and noise words, and words of the place's names or nearly so."""
    near = F.exists(place_tokens, lambda p: (p == word) | ((F.length(p) >= PLACE_LENGTH) & (dice(p, word) >= PLACE_DICE)))
    return word.isin(*GENERIC_WORDS, *NOISE_WORDS) | F.coalesce(near, F.lit(False))


def containment(a: Column, b: Column, place_tokens: Column) -> Column:
    """Whether one core token list holds the other: extra words of the source (a) are fine, extra words of the map (b) must be place context, and the shared ones must say enough."""
    telling = lambda shared: (F.length(F.array_join(shared, " ")) >= SHARED_LENGTH) & F.exists(shared, lambda w: ~is_place_word(w, place_tokens))
    covers = F.forall(b, lambda w: F.array_contains(a, w)) & (F.size(b) > 0) & telling(b)
    covered = F.forall(a, lambda w: F.array_contains(b, w)) & (F.size(a) > 0) & F.forall(b, lambda w: F.array_contains(a, w) | is_place_word(w, place_tokens)) & telling(a)
    return covers | covered


def name_features(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """df plus what match_features() needs of a name, computed once per row and not once per pair."""
    d = df.withColumn(f"{prefix}n", normalize_name(F.col(name)))
    d = d.withColumn(f"{prefix}t", name_tokens(F.col(f"{prefix}n"), True, True))
    d = d.withColumn(f"{prefix}c", F.array_join(f"{prefix}t", " "))
    return d.withColumn(f"{prefix}g", numbered(bigrams(F.col(f"{prefix}n")))).withColumn(f"{prefix}h", numbered(bigrams(F.col(f"{prefix}c"))))


def match_features(a: str, b: str, place_tokens: Column) -> Column:
    """struct(kind, score) of two names with features under these prefixes, null if unrelated. The first test that holds decides."""
    an, bn, at, bt, ac, bc = (F.col(f"{p}{k}") for k in "ntc" for p in (a, b))
    give = lambda kind, score: F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("score"))
    full = dice(an, bn, F.col(f"{a}g"), F.col(f"{b}g"))
    core = dice(ac, bc, F.col(f"{a}h"), F.col(f"{b}h"))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (
        F.when((an == "") | (bn == ""), F.lit(None))
        .when(an == bn, give("exact", F.lit(EXACT_SCORES[0])))
        .when((ac == "") | (bc == ""), F.lit(None))
        .when(ac == bc, give("exact", F.lit(EXACT_SCORES[1])))
        .when(tight(ac) == tight(bc), give("exact", F.lit(EXACT_SCORES[2])))
        .when(containment(at, bt, place_tokens), give("strong", F.lit(STRONG_SCORE)))
        .when(full >= FUZZY, give("fuzzy", full))
        .when(core >= CORE_FUZZY, give("fuzzy", core))
    )


def place_tokens(*names: Column) -> Column:
    """Tokens of a place's names, nulls left out."""
    return F.flatten(F.array_compact(F.array(*[name_tokens(n) for n in names])))


def match_names(pairs: DataFrame, source: str, target: str, place: Column | None = None) -> DataFrame:
    """pairs plus match: struct(kind, score) or null."""
    d = name_features(name_features(pairs, source, "_a"), target, "_b").withColumn("_p", place if place is not None else F.array().cast("array<string>"))
    return d.withColumn("match", match_features("_a", "_b", F.col("_p"))).select(*pairs.columns, "match")


def _keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a, b), block, n, key for the distinct names of both sides: names that match share a key.

    Exact matches share the name or its core without spaces. Of a strong pair all core words of one name are in the other, so
    the rarest word of that one is: it meets every word of the other side, and frequent words don't meet each other. Of a
    name's x bigrams a pair whose dice is `least` or more has at least x * least / (2 - least) in common, so one is among the
    rest and one more, whatever the order, if it is the same for both: the rarest come first. Words and bigrams of both
    sides are counted and ranked in one pass.
    """
    tagged = lambda tag, c: F.transform(c, lambda t: F.struct(F.lit(tag).alias("tag"), F.size(c).alias("x"), t.alias("t")))
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    parts = both.select("side", "block", "n", F.inline(F.concat(tagged("g", F.col("g")), tagged("h", F.col("h")), tagged("w", F.array_distinct("t")))))
    often = parts.groupBy("block", "tag", "t").agg(F.count("*").alias("df"))
    ranked = parts.join(often, ["block", "tag", "t"]).withColumn("r", F.row_number().over(Window.partitionBy("side", "block", "n", "tag").orderBy("df", "t")))
    front = lambda least: F.col("r") <= F.col("x") - F.ceil(F.col("x") * (least / (2 - least)) - 1e-9) + 1
    gram = (F.col("tag") == "g") & front(FUZZY) | (F.col("tag") == "h") & front(CORE_FUZZY)
    word = F.col("tag") == "w"
    own, other = F.concat(F.lit("w"), "side", F.lit(":"), "t"), F.concat(F.when(F.col("side") == "a", "wb:").otherwise("wa:"), "t")
    keys = F.array_compact(F.array(F.when(gram, F.concat("tag", F.lit(":"), "t")), F.when(word & (F.col("r") == 1), own), F.when(word, other)))
    exact = F.array_compact(F.array(F.concat(F.lit("n:"), "n"), F.when(F.col("c") != "", F.concat(F.lit("c:"), F.replace("c", F.lit(" "), F.lit(""))))))
    return ranked.select("side", "block", "n", F.explode(keys).alias("key")).unionByName(both.select("side", "block", "n", F.explode(exact).alias("key"))).distinct()


def fuzzy_block_join(venues: DataFrame, places: DataFrame, block: str, source: str = "name", target: str = "place_name", place: Column | None = None) -> DataFrame:
    """Pairs of venues and places of one block whose names match; null blocks match nothing.

    Distinct names meet only if they share a key that any match must share: the name, its core, the rarest core word of
    either, or one of the rarest bigrams. So a large block isn't multiplied out, and nothing is lost.
    """
    v = venues.withColumn("_block", F.col(block)).where("_block is not null").withColumn("_name", F.col(source)).withColumn("_place", place if place is not None else F.array().cast("array<string>"))
    t = places.withColumn("_tblock", F.col(block)).where("_tblock is not null").drop(block).withColumn("_target", F.col(target))
    # Features of distinct names, made once and stored; pairs are pairs of numbers until their scores are known.
    left = stored(name_features(v.select("_block", "_name", "_place").distinct(), "_name", "_a").withColumn("_i", F.monotonically_increasing_id()), "names")
    right = stored(name_features(t.select("_tblock", "_target").distinct(), "_target", "_b").withColumn("_j", F.monotonically_increasing_id()), "names")
    plain = lambda d, b, p: d.select(F.col(b).alias("block"), *[F.col(f"{p}{k}").alias(k) for k in "ntcgh"]).distinct()
    names = plain(left, "_block", "_a"), plain(right, "_tblock", "_b")
    keys = stored(_keys(*names), "keys")
    a, b = left.withColumnRenamed("_block", "block").withColumnRenamed("_an", "n"), right.withColumnRenamed("_tblock", "block").withColumnRenamed("_bn", "n")
    side = lambda s, d, i: keys.where(F.col("side") == s).join(d.select("block", "n", i), ["block", "n"]).select("block", "key", i)
    near = side("a", a, "_i").join(side("b", b, "_j"), ["block", "key"]).select("_i", "_j").distinct()
    scored = near.join(left, "_i").join(right, "_j").withColumn("match", match_features("_a", "_b", F.col("_place"))).where("match is not null")
    scored = scored.select(F.col("_block").alias("_sb"), F.col("_name").alias("_sa"), F.col("_place").alias("_sp"), F.col("_target").alias("_st"), "match")
    out = v.join(scored, (F.col("_block") == F.col("_sb")) & (F.col("_name") == F.col("_sa")) & (F.col("_place") == F.col("_sp"))).join(t, (F.col("_sb") == F.col("_tblock")) & (F.col("_st") == F.col("_target")))
    return out.select(*venues.columns, *[c for c in places.columns if c != block], "match")


def best_match(matches: DataFrame, key: str, target: str = "place_name") -> DataFrame:
    """The best match per key and whether it is ambiguous: one of its kind with nearly its score lies elsewhere.

    Rank by kind, then score; ties by name and coordinates (lat, lon).
    """
    rank = F.when(F.col("match.kind") == "exact", 3).when(F.col("match.kind") == "strong", 2).otherwise(1)
    m = matches.withColumn("_rank", rank)
    w = Window.partitionBy(key).orderBy(F.desc("_rank"), F.desc("match.score"), target, "lat", "lon")
    m = m.withColumn("_n", F.row_number().over(w))
    top = F.first(F.struct("_rank", "match.score", "lat", "lon")).over(w)
    m = m.withColumn("_top", top)
    rival = (F.col("_rank") == F.col("_top._rank")) & (F.abs(F.col("match.score") - F.col("_top.score")) < NEAR_SCORE) & (distance_m(F.col("lat"), F.col("lon"), F.col("_top.lat"), F.col("_top.lon")) > SAME_PLACE_M)
    m = m.withColumn("ambiguous", F.max(rival).over(Window.partitionBy(key)))
    return m.where("_n = 1").drop("_rank", "_n", "_top")
