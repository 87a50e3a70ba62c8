"""Publication of a build: tables, their timestamp and their document, written only if something has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.listing import write_document
from ..sources.paths import committed, exists, part_names
from . import merge

META = "generated_at timestamp, source_updated_at date, mark string"


@dataclass
class Published:
    """What is published now: the folder of its tables, its timestamp, and whether this call wrote it."""

    path: str
    generated_at: object
    changed: bool


def _latest(spark: SparkSession, path: str) -> str | None:
    done = [n for n in part_names(spark, path, "version=") if committed(spark, f"{path}/{n}/meta")]
    return f"{path}/{done[-1]}" if done else None


def _mark(tables: dict[str, DataFrame], source_updated_at: str | None) -> str:
    """Fingerprints of all tables and the source's date: whatever else is said of a publication doesn't count."""
    one = {n: merge.fingerprint(d).first() for n, d in tables.items()}
    return "; ".join([f"{n} {r['n']} {r['x']} {r['s']}" for n, r in sorted(one.items())] + [str(source_updated_at)])


def published(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the last publication and its meta row; None before the first."""
    at = _latest(spark, path)
    return {n: spark.read.parquet(f"{at}/{n}") for n in part_names(spark, at, "")} if at else None


def publish(tables: dict[str, DataFrame], now: str, path: str, source_updated_at: str | None = None, document: str | None = None, nullable: tuple[str, ...] = ("weekday", "time", "source_updated_at")) -> Published:
    """Publish tables (by name) below path, and as one JSON document if a path is given for it.

    If rows and source date are those of the last publication, in whatever order, nothing is written and its timestamp stays:
    one stored row is read and the new tables are aggregated once, the old ones aren't read. Else the tables are a new version,
    whose meta row is written last; a publication that is broken off isn't one. A missing document is written again.
    """
    spark = next(iter(tables.values())).sparkSession
    last, mark = _latest(spark, path), _mark(tables, source_updated_at)
    meta = spark.read.schema(META).parquet(f"{last}/meta").first() if last else None
    changed = meta is None or meta["mark"] != mark
    if changed:
        number = len(part_names(spark, path, "version="))
        last = f"{path}/version={number:06d}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{last}/{name}")
        row = spark.range(1).select(F.lit(now).cast("timestamp").alias("generated_at"), F.lit(source_updated_at).cast("date").alias("source_updated_at"), F.lit(mark).alias("mark"))
        row.write.mode("overwrite").parquet(f"{last}/meta")
        meta = row.first()
    if document and (changed or not exists(spark, document)):
        stamp = F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at")
        own = spark.read.schema(META).parquet(f"{last}/meta").select(stamp, F.col("source_updated_at").cast("string").alias("source_updated_at"))
        write_document({n: spark.read.parquet(f"{last}/{n}") for n in tables}, own, document, nullable=nullable)
    return Published(last, meta["generated_at"], changed)
