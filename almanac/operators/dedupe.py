"""First-wins deduplication, unique ids and slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..sources.paths import stored
from .skew import ranked


def dedupe_first_wins(rows: DataFrame, key: str, order: str, backfill: list[list[str]]) -> DataFrame:
    """One row per key: the first by order. Each group of columns in backfill comes, together, from the first row whose leading one isn't null or empty."""
    filled = {c for g in backfill for c in g}
    plain = [c for c in rows.columns if c not in filled and c != key]
    aggs = [F.min_by(F.struct(*plain), F.col(order)).alias("_first")]
    aggs += [F.min_by(F.struct(*g), F.when(F.nullif(F.col(g[0]), F.lit("")).isNotNull(), F.col(order))).alias(f"_g{i}") for i, g in enumerate(backfill)]
    return rows.groupBy(key).agg(*aggs).select(key, *[f"_first.{c}" for c in plain], *[F.col(f"_g{i}")[c].alias(c) for i, g in enumerate(backfill) for c in g])


def make_unique(df: DataFrame, base: str, hints: list[str], order: str, out: str = "unique_id", most: int | None = None) -> DataFrame:
    """df plus an id of its own for each row: the base for the first by order, `base-hint` for the first of the rest that find it free, then `base-2`, `base-3`, ...

    Passes over what is left, each giving an id to its first taker: bases of all rows come before any hint, and hints of one
    place before those of the next. Hints of different places should have no value in common. What a pass has given is
    stored, so that the next one doesn't repeat it. Numbers are ranks of skew.ranked(), with its `most`: a base that all rows
    share is spread over all tasks.
    """
    least = lambda d, k: d.groupBy(k).agg(F.min(order).alias("_least"))
    step = df.join(least(df, base), base).withColumn("_won", F.col(order) == F.col("_least")).drop("_least")
    step = stored(step.withColumn(out, F.when(F.col("_won"), F.col(base))), "bases")
    done, left = [step.where("_won").drop("_won")], step.where("not _won").drop("_won", out)
    for h in hints:
        taken = _union([d.select(F.col(out).alias("_c")) for d in done]).distinct()
        asked = left.withColumn("_c", F.concat(F.col(base), F.lit("-"), slug(F.col(h))))
        free = least(asked.where("_c is not null").select("_c", order), "_c").join(taken, "_c", "left_anti")
        won = F.col(order).eqNullSafe(F.col("_least"))
        step = stored(asked.join(free, "_c", "left").withColumn("_won", F.col("_least").isNotNull() & won).withColumn(out, F.when(F.col("_won"), F.col("_c"))).select(*df.columns, "_won", out), "hints")
        done.append(step.where("_won").drop("_won"))
        left = step.where("not _won").drop("_won", out)
    given = _union([d.select(*df.columns, out) for d in done])
    return given.unionByName(_numbered(left, given, base, order, out, most).select(*given.columns))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(left: DataFrame, done: DataFrame, base: str, order: str, out: str, most: int | None) -> DataFrame:
    """left with base-2, base-3, ... in order, without the numbers that ids in done have already.

    Of the numbers that are used, the i-th (from 0), u, has u - 2 - i free ones before it; the k-th row passes those that
    have fewer than k. Rows and used numbers are put in one order by that, so no row looks through them.
    """
    used = done.select(F.regexp_extract(out, "^(.*)-[0-9]{1,9}$", 1).alias("_b"), F.regexp_extract(out, "-([0-9]{1,9})$", 1).alias("_u")).where("_u <> ''")
    used = used.select("_b", F.col("_u").cast("long").alias("_u")).where("_u > 1").distinct()
    used = ranked(used, ["_b"], [F.col("_u")], "_i", most).select("_b", (F.col("_u") - F.col("_i") - 1).alias("_free"), F.lit(1).alias("_is"))
    rows = ranked(left.withColumn("_b", F.col(base)), ["_b"], [F.col(order)], "_free", most)
    both = rows.withColumn("_is", F.lit(0)).unionByName(used, allowMissingColumns=True)
    # Of a used number and a row with equal k the row comes first: it has k - 1 free numbers before it.
    both = ranked(both, ["_b"], [F.col("_free"), F.col("_is")], "_at", most)
    passed = F.col("_at") - F.col("_free")  # of a row, which is the _free-th of its kind
    n = both.withColumn("_n", F.col("_free") + 1 + passed).where("_is = 0")
    return n.withColumn(out, F.concat(F.col(base), F.lit("-"), F.col("_n").cast("string"))).drop("_b", "_free", "_is", "_n", "_at")


def slug_map(df: DataFrame, value: str, qualifier: str, order: str, fallback: str = "sted", most: int | None = None) -> DataFrame:
    """value, slug for each distinct value: its own slug for the first by value, `value-qualifier` for the next, then numbers. Independent of row order but for the qualifier, that of the first row."""
    one = df.groupBy(value).agg(F.min_by(qualifier, order).alias("_q"))
    blank = lambda c: F.nullif(c, F.lit(""))
    one = one.withColumn("_base", F.coalesce(blank(slug(F.col(value))), blank(slug(F.col("_q"))), F.lit(fallback)))
    one = one.withColumn("_hint", F.coalesce(blank(slug(F.concat_ws("-", value, "_q"))), F.concat(F.col("_base"), F.lit("-2"))))
    named = ranked(one, ["_base"], [F.col(value)], "_n", most)
    done = named.where("_n = 1").select(value, F.col("_base").alias("slug"))
    left = named.where("_n > 1").drop("_n").join(done.select(F.col("slug").alias("_t"), F.lit(True).alias("_is")), F.col("_hint") == F.col("_t"), "left").drop("_t")
    left = ranked(left, ["_hint"], [F.col(value)], "_n", most)
    got = F.col("_is").isNull() & (F.col("_n") == 1)
    done = done.unionByName(left.where(got).select(value, F.col("_hint").alias("slug")))
    return done.unionByName(_numbered(left.where(~got).drop("_n", "_is"), done, "_base", value, "slug", most).select(value, "slug"))


def invert_map(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(value).alias(value), F.col(key).alias(key))


def carry_forward(df: DataFrame, col: str, partition: str, order: str) -> DataFrame:
    """Nulls of col take the last value before them."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def collated(c: Column | str, locale: str = "nb") -> Column:
    return F.collate(F.col(c) if isinstance(c, str) else c, locale)


def numbered(df: DataFrame, group: str, first: str, then: list[Column], out: str) -> DataFrame:
    """df plus the row's place in its group by `first` (nulls last) and `then`, from 1 (see skew.ranked())."""
    return ranked(df, [group], [F.asc_nulls_last(first), *then], out)


def sort_by_time_name(df: DataFrame, time: str = "time", name: str = "name", key: str = "id") -> DataFrame:
    """Time ascending with nulls last, then the name as Norwegians sort, then the key."""
    return df.orderBy(F.asc_nulls_last(time), collated(name), key)


def sort_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(key)


def preview(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by order, each with how many more there are."""
    total = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(order).limit(n).crossJoin(F.broadcast(total))
