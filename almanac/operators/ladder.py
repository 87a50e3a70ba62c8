"""A ladder that can be broken off and taken up again: an append-only store of points, one commit per batch and rung."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.paths import committed, mark, part_names
from .geo import POINT, one_each, region_process_order

Rung = tuple[str, Callable[[DataFrame], DataFrame]]
STORED = f"{POINT}, resolved_at timestamp"


def points(spark: SparkSession, path: str) -> DataFrame:
    """POINT and resolved_at of all commits below path, one row per id: the one that was stored first (ties as one_each())."""
    found = [f"{path}/{r}/{b}/{c}" for r in part_names(spark, path, "run=") for b in part_names(spark, f"{path}/{r}", "batch=") for c in part_names(spark, f"{path}/{r}/{b}", "rung=") if committed(spark, f"{path}/{r}/{b}/{c}")]
    if not found:
        return spark.createDataFrame([], STORED)
    own = ("resolved_at", "geo_source", "geo_confidence", "lat", "lon")
    all_rows = spark.read.schema(STORED).parquet(*found).groupBy("id").agg(F.min(F.struct(*own)).alias("p"))
    return all_rows.select("id", "p.lat", "p.lon", "p.geo_source", "p.geo_confidence", "p.resolved_at")


def _todo(venues: DataFrame, known: DataFrame, key: str, nr: str, per_batch: int) -> DataFrame:
    """id, _nr, batch of venues that aren't known: whole regions in order, per_batch venues or so together."""
    ids = venues.select(F.col(key).cast("string").alias("id"), region_process_order(F.col(nr)).alias("_nr"))
    left = ids.join(known.select("id"), "id", "left_anti").where("id is not null").groupBy("id").agg(F.min("_nr").alias("_nr"))
    before = Window.orderBy("_nr").rowsBetween(Window.unboundedPreceding, -1)  # one row per region
    sizes = left.groupBy("_nr").agg(F.count("*").alias("n")).withColumn("batch", (F.coalesce(F.sum("n").over(before), F.lit(0)) / per_batch).cast("int"))
    return left.join(sizes.select("_nr", "batch"), "_nr").select("id", "_nr", "batch")


def run_ladder(venues: DataFrame, rungs: list[Rung], path: str, limit: int | None = None, per_batch: int = 100_000, key: str = "id", nr: str = "kommune_nr", skip_failing: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """POINT of the venues that this run places, in no order: the first rung that has a point for a venue decides.

    What is in the store below path already isn't looked up. The others are taken in batches of whole regions, by region number
    (null last); each rung gets what those before it left of the batch, and its points are one commit. A run that is
    broken off leaves its commits; the next call goes on behind the last one and gives what the broken run would have given.
    With a limit no further batch is begun once so many are placed, and the first of them by region and id are
    returned; what their batch has beyond that is in the store for the next run, as are all points for good.

    A rung that fails ends the run, unless skip_failing is given: then it is told the rung and the error, the rung is left out
    for this batch, and the venues it might have had go to the next one. Venues without a point are looked up again by the
    next run. A venue that a rung gives several points has the least (see one_each()); null ids are left out.
    """
    spark = venues.sparkSession
    runs = part_names(spark, path, "run=")
    now = runs[-1] if runs and not committed(spark, f"{path}/{runs[-1]}/done") else f"run={len(runs):06d}"
    plan = f"{path}/{now}/todo"
    if not committed(spark, plan):
        _todo(venues, points(spark, path), key, nr, per_batch).write.mode("overwrite").parquet(plan)
    todo = spark.read.schema("id string, _nr string, batch int").parquet(plan)
    batches = [r[0] for r in todo.select("batch").distinct().orderBy("batch").collect()]  # as many as per_batch makes of the venues
    out, placed = [], 0
    for b in batches:
        own = todo.where(F.col("batch") == b).select(F.col("id").alias("_id"))
        left = venues.join(own, F.col(key).cast("string") == F.col("_id"), "left_semi")
        for k, (name, rung) in enumerate(rungs):
            at = f"{path}/{now}/batch={b:06d}/rung={k:02d}-{name}"
            if not committed(spark, at):
                try:
                    got = one_each(rung(left)).join(left.select(F.col(key).cast("string").alias("id")), "id", "left_semi")
                    got.withColumn("resolved_at", F.current_timestamp()).write.mode("overwrite").parquet(at)
                except Exception as e:
                    if skip_failing is None:
                        raise
                    skip_failing(name, e)
                    continue
            got = spark.read.schema(STORED).parquet(at)
            out.append(got)
            left = left.join(got.select(F.col("id").alias("_id")), F.col(key).cast("string") == F.col("_id"), "left_anti")
            placed += got.count()
        if limit is not None and placed >= limit:
            break
    mark(spark, f"{path}/{now}/done")
    if not out:
        return spark.createDataFrame([], POINT)
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    if limit is not None:
        found = found.join(todo, "id").orderBy("_nr", "id").limit(limit)
    return found.select("id", "lat", "lon", "geo_source", "geo_confidence")
