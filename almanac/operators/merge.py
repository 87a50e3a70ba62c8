"""A snapshot meets the one before: enrichment, overrides, soft deletion, reports and rails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MAX_CHURN = 250, 0.1


def join_with_orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> tuple[DataFrame, DataFrame]:
    """(items, orphans): facts with their dimension row, and facts without one. Small dimensions are broadcast by their size."""
    on = fact[fact_key] == dim[dim_key]
    return fact.join(dim, on), fact.join(dim, on, "left_anti")


def enrich(df: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns of side where those aren't null; others keep what they had, or null."""
    s = side.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(s, F.col(key) == F.col("_k"), "left")
    own = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), own(c)) for c in columns}).drop("_k", *[f"_{c}" for c in columns])


def apply_overrides(df: DataFrame, patch: DataFrame, key: str = "id", set_fields: str = "set_fields") -> DataFrame:
    """Fields named in a patch row's set_fields take its value, null included; others keep theirs. A patch may not set the key."""
    fields = [c for c in patch.columns if c in df.columns and c != key]
    p = patch.select(F.col(key).alias("_k"), F.when(F.array_contains(set_fields, key), F.raise_error(F.lit(f"a patch may not change {key}")).cast("array<string>")).otherwise(F.col(set_fields)).alias("_set"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = df.join(p, F.col(key) == F.col("_k"), "left")
    return out.withColumns({c: F.when(F.coalesce(F.array_contains("_set", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).select(*df.columns)


def soft_delete(current: DataFrame, previous: DataFrame, key: str, today: str, last_seen: str = "last_seen", stale: str = "stale") -> DataFrame:
    """Current rows, seen today and not stale, and rows of previous that have gone, marked stale with the date they had."""
    now = current.withColumn(last_seen, F.lit(today).cast("date")).withColumn(stale, F.lit(False))
    gone = previous.join(current.select(key), key, "left_anti").withColumn(stale, F.lit(True))
    return now.unionByName(gone.select(*now.columns))


def apply_to_snapshot(df: DataFrame, patch: DataFrame | None, key: str = "id", stale: str = "stale") -> DataFrame:
    """apply_overrides() after soft_delete(): all fields may be patched, but a row of the current snapshot isn't stale, whatever the patch says. Without a patch, df."""
    if patch is None:
        return df
    out = apply_overrides(df.withColumn("_live", ~F.col(stale)), patch, key)
    return out.withColumn(stale, F.col(stale) & ~F.col("_live")).drop("_live")


def new_ids(current: DataFrame, previous: DataFrame, key: str, stale: str = "stale") -> DataFrame:
    """Ids of current that no live row of previous has."""
    live = previous.where(~F.coalesce(F.col(stale), F.lit(False)))
    return current.select(key).join(live.select(key), key, "left_anti").distinct()


def removed_ids(current: DataFrame, previous: DataFrame, key: str, live_only: bool = False, stale: str = "stale") -> DataFrame:
    """Ids of previous that current lacks; those that were stale already count again unless live_only."""
    p = previous.where(~F.coalesce(F.col(stale), F.lit(False))) if live_only else previous
    return p.select(key).join(current.select(key), key, "left_anti").distinct()


def changed_ids(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return new_ids(current, previous, key).union(removed_ids(current, previous, key)).distinct()


def build_report(current: DataFrame, previous: DataFrame, key: str, stale: str = "stale", venues: DataFrame | None = None) -> DataFrame:
    """One row: n_current, n_previous_live, n_stale, n_new, n_removed, churn (changed ids by the larger live count; 0 on a first run); with the merged venues also n_venues and n_stale_venues. Both snapshots are counted by id in one shuffle."""
    live = (~F.coalesce(F.col(stale), F.lit(False))).cast("long")
    both = current.select(key, F.lit(1).alias("_c"), F.lit(0).alias("_p"), F.lit(0).cast("long").alias("_l")).unionByName(previous.select(key, F.lit(0).alias("_c"), F.lit(1).alias("_p"), live.alias("_l")))
    ids = both.groupBy(key).agg(F.sum("_c").alias("c"), F.sum("_p").alias("p"), F.sum("_l").alias("l"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    new, gone = (F.col("c") > 0) & (F.col("l") == 0), (F.col("c") == 0) & (F.col("p") > 0)
    out = ids.agg(
        total("c").alias("n_current"), total("l").alias("n_previous_live"), total(F.when(F.col("c") == 0, F.col("p"))).alias("n_stale"),
        F.count_if(new).alias("n_new"), F.count_if(gone).alias("n_removed"), F.count_if(new | gone).alias("_changed"),
    )
    churn = F.when(F.col("n_previous_live") == 0, F.lit(0.0)).otherwise(F.col("_changed") / F.greatest("n_previous_live", "n_current"))
    out = out.withColumn("churn", churn).drop("_changed")
    if venues is None:
        return out
    return out.crossJoin(F.broadcast(venues.agg(F.count("*").alias("n_venues"), F.count_if(F.coalesce(F.col(stale), F.lit(False))).alias("n_stale_venues"))))  # one row each


def check_rails(report: DataFrame, min_rows: int = MIN_ROWS, max_churn: float = MAX_CHURN, force: bool = False) -> DataFrame:
    """A row (rail, value, bound, blocks) for each rail that trips: strictly fewer rows, strictly more churn. force records without blocking."""
    rail = lambda bad, name, value, bound: F.when(bad, F.struct(F.lit(name).alias("rail"), value.cast("double").alias("value"), F.lit(float(bound)).alias("bound"), F.lit(not force).alias("blocks")))
    trips = F.array_compact(F.array(rail(F.col("n_current") < min_rows, "rows", F.col("n_current"), min_rows), rail(F.col("churn") > max_churn, "churn", F.col("churn"), max_churn)))
    return report.select(F.inline(trips))


def fingerprint(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row (n, x, s) that tables of equal rows share in whatever order rows and columns are: the count and two sums of hashes, repeats counted. An aggregation; nothing is sorted."""
    cols = sorted(c for c in df.columns if c not in ignore)
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in cols])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(h, F.lit(7)).cast("decimal(38,0)")).alias("s"))


def same_except(a: DataFrame, b: DataFrame, ignore: list[str]) -> DataFrame:
    """One row: same, true if both hold equal rows (repeats counted) apart from the ignored columns, by fingerprint()."""
    mark = lambda d, name: fingerprint(d, tuple(ignore)).select(F.struct("n", "x", "s").alias(name))
    return mark(a, "a").crossJoin(mark(b, "b")).select(F.col("a").eqNullSafe(F.col("b")).alias("same"))
