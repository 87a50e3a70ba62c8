"""Place names to the official register, by name and by gazetteer; what stays in doubt stays unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_place, place_rank, region_number, slug, strip_place_qualifier
from ..sources.paths import stored
from .dedupe import collated

# ---- fixed values ----
METHODS = ("manual", "exact", "normalized", "stedsnavn")
# ---- end of fixed values ----
_ENTRY = ("kommune_nr", "kommune_name", "fylke_now", "method")


def _keyed(places: DataFrame) -> DataFrame:
    return places.select("place", "fylke").distinct().withColumn("_key", normalize_place(F.col("place"))).withColumn("_want", region_number(F.col("fylke")))


def resolve_direct(places: DataFrame, register: DataFrame) -> DataFrame:
    """place, fylke, status (resolved, ambiguous, none), kommune_nr, kommune_name, fylke_now, method, candidates.

    One municipality of that name: taken if the unstripped name is equal (exact) or its county agrees or can't be told
    (normalized; a null or unknown county can't be told); else `none`, which a gazetteer may still resolve. Several: the only one in the county, else ambiguous
    with all as candidates, for good.
    """
    r = register.select(normalize_place(F.col("navn")).alias("_key"), "nr", "navn", "fylkesnr", F.col("fylke").alias("_now"))
    # Null counties are places like others: rows stay with their place, so that nothing is joined back.
    hit = _keyed(places).join(r, "_key", "left")
    here = F.col("fylkesnr") == F.col("_want")
    item = F.struct("nr", "navn", F.col("_now").alias("fylke"), (slug(F.col("navn")) == slug(F.col("place"))).alias("exact"), F.coalesce(here, F.col("_want").isNull()).alias("agrees"))
    met = F.col("nr").isNotNull()
    out = hit.groupBy("place", "fylke").agg(
        F.count("nr").alias("_n"), F.count_if(F.coalesce(here, F.lit(False))).alias("_in"), F.min(F.when(met, item)).alias("_one"), F.min_by(item, F.when(here, F.col("nr"))).alias("_own"),
        F.array_sort(F.collect_list(F.concat("navn", F.lit(" ("), "nr", F.lit(")")))).alias("_all"),
    )
    single = (F.col("_n") == 1) & (F.col("_one.exact") | F.col("_one.agrees"))
    several = (F.col("_n") > 1) & (F.col("_in") == 1)
    chosen = F.when(single, F.col("_one")).when(several, F.col("_own"))
    method = F.when(single & F.col("_one.exact"), F.lit("exact")).when(single | several, F.lit("normalized"))
    out = out.withColumn("_c", chosen)
    status = F.when(F.col("_c").isNotNull(), F.lit("resolved")).when(F.col("_n") > 1, F.lit("ambiguous")).otherwise(F.lit("none"))
    return out.select("place", "fylke", status.alias("status"), F.col("_c.nr").alias("kommune_nr"), F.col("_c.navn").alias("kommune_name"), F.col("_c.fylke").alias("fylke_now"), method.alias("method"), F.when(status == "ambiguous", F.col("_all")).alias("candidates"))


def resolve_gazetteer(places: DataFrame, hits: DataFrame, register: DataFrame, top: int = 5) -> DataFrame:
    """Like resolve_direct, from gazetteer hits (query, navn, type, kommunenummer) of each place.

    A place without any hit is looked up once more without its qualifier (` i Somewhere`). Hits in the county come first, then equal names, then by place type (ties: register number, name). The best must be in
    the county and have the name, else the place is unresolved with the first few as candidates.
    """
    r = register.select("nr", F.col("navn").alias("_knavn"), "fylkesnr", F.col("fylke").alias("_now"))
    p = _keyed(places)
    asked = hits.select("query").distinct()
    again = p.join(asked, p["place"] == asked["query"], "left_anti").withColumn("_q", strip_place_qualifier(F.col("place")))
    p2 = p.withColumn("_q", F.col("place")).unionByName(again.where("_q <> place"))
    hit = p2.join(hits, p2["_q"] == hits["query"], "left").join(r, F.col("kommunenummer") == F.col("nr"), "left")
    here = F.coalesce(F.col("fylkesnr") == F.col("_want"), F.lit(False))
    same = normalize_place(F.col("navn")) == F.col("_key")
    order = F.struct((~here).alias("a"), (~same).alias("b"), (-place_rank(F.col("type"))).alias("c"), F.col("nr").alias("d"), F.col("navn").alias("e"), F.col("_knavn").alias("k"), F.col("_now").alias("f"), F.concat("navn", F.lit(" ["), "type", F.lit("] -> "), "_knavn").alias("t"))
    order = F.when(F.col("nr").isNotNull(), order)
    out = hit.groupBy("place", "fylke").agg(F.min(order).alias("_best"), F.transform(F.slice(F.sort_array(F.collect_set(order)), 1, top), lambda x: x["t"]).alias("_all"))
    out = out.withColumn("_all", F.when(F.size("_all") > 0, F.col("_all")))
    ok = F.coalesce(~F.col("_best.a") & ~F.col("_best.b"), F.lit(False))
    pick = lambda c: F.when(ok, F.col(f"_best.{c}"))
    return out.select("place", "fylke", F.when(ok, F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"), pick("d").alias("kommune_nr"), pick("k").alias("kommune_name"), pick("f").alias("fylke_now"), F.when(ok, F.lit("stedsnavn")).alias("method"), F.when(~ok, F.col("_all")).alias("candidates"))


def resolve_places(venues: DataFrame, register: DataFrame, hits: DataFrame, existing: DataFrame, order: str = "row_idx") -> DataFrame:
    """place, fylke, status and entry of each place that isn't in existing (place): direct, then by gazetteer. The county is that of the place's first row."""
    p = venues.groupBy("place").agg(F.min_by("fylke", order).alias("fylke")).join(existing.select("place"), "place", "left_anti")
    direct = resolve_direct(p, register)
    more = resolve_gazetteer(direct.where("status = 'none'").select("place", "fylke"), hits, register)
    return direct.where("status <> 'none'").unionByName(more)


def merge_aliases(existing: DataFrame, resolved: DataFrame) -> DataFrame:
    """The alias table (columns of existing: place, kommune_nr, kommune_name, fylke_now, method, ...) with what resolve_places() resolved, in Norwegian order of the place.

    Known places stay as they are, whatever was resolved for them; of rows of one place the one of best provenance stays
    (manual, exact, normalized, stedsnavn, others; ties by number and name). Places that stay open get no row, so that they are tried again.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")), F.lit(0))
    rank = F.when(rank == 0, len(METHODS) + 1).otherwise(rank)
    rest = [c for c in existing.columns if c != "place"]
    one = existing.where("place is not null").groupBy("place").agg(F.min_by(F.struct(*rest), F.struct(rank.alias("a"), "kommune_nr", "kommune_name")).alias("_r")).select("place", "_r.*")
    new = resolved.where("status = 'resolved' and place is not null").select("place", *_ENTRY).dropDuplicates(["place"]).join(existing.select("place"), "place", "left_anti")
    return one.unionByName(new, allowMissingColumns=True).select(*existing.columns).orderBy(collated("place"))


def keep_aliases(venues: DataFrame, register: DataFrame, hits: DataFrame, existing: DataFrame, order: str = "row_idx") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alias table, what a person has to decide, counts): one run of upkeep. A second run on its table resolves nothing anew and gives the same table."""
    got = stored(resolve_places(venues.where("place is not null"), register, hits, existing, order), "resolved")
    return merge_aliases(existing, got), to_curate(got), resolution_report(venues.where("place is not null"), existing, got)


def alias_method_counts(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("method").agg(F.count("*").alias("n"))


def resolution_report(venues: DataFrame, existing: DataFrame, resolved: DataFrame) -> DataFrame:
    """metric, n: places named, known already, resolved now, unresolved (ambiguous ones too)."""
    named = venues.select("place").distinct().join(existing.select("place", F.lit(1).alias("known")).distinct(), "place", "left")
    a = named.agg(F.count("*").alias("places"), F.count("known").alias("known"))
    b = resolved.agg(F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") != "resolved").alias("unresolved"))
    return a.crossJoin(b).unpivot([], ["places", "known", "resolved", "unresolved"], "metric", "n")


def to_curate(resolved: DataFrame, top: int = 4) -> DataFrame:
    """place, fylke, status and the first few candidates of what a person has to decide."""
    return resolved.where("status <> 'resolved'").select("place", "fylke", "status", F.slice(F.coalesce("candidates", F.array().cast("array<string>")), 1, top).alias("candidates"))
