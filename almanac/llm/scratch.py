"""Tables in the shared folder, to cut lineage without losing data when an executor dies."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Keys of so many words of 8 bytes at most are broadcast, after they were counted; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which goes when the driver ends.

    Where that setting is missing, a local session gets a temporary folder; on a cluster that is an error, since executors
    don't share such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid4().hex}"
    _files(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


def _files(spark: SparkSession, path: str, act) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once, written as Parquet to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _files(t.sparkSession, path, lambda fs, p: fs.delete(p, True))


def join_ids(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join of rows with distinct keys, a written table. Few keys are broadcast, so that wide rows aren't shuffled."""
    words = sum(5 if t == "string" else 1 for _, t in ids.select(*on).dtypes)
    few = ids.count() * words <= BROADCAST_IDS
    return rows.join(ids.select(*on).hint("broadcast" if few else "merge"), on, how)


def sized(table: DataFrame, words: int) -> DataFrame:
    """A written table of rows of so many words of 8 bytes, as the right side of a join: broadcast if it was counted small, else merged."""
    return table.hint("broadcast" if table.count() * words <= BROADCAST_IDS else "merge")


def set_aside(docs: DataFrame, inner: set[str], *named: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with those columns renamed that an operator has names of its own for (inner, lower case), the names that the columns `named` have now, and what gives a result its names back."""
    taken, new = {c.lower() for c in docs.columns} | inner, {}
    for c in docs.columns:
        if c.lower() in inner:
            name = f"own_{c}"
            while name.lower() in taken:
                name = f"own_{name}"
            taken.add(name.lower())
            new[c] = name
    back = {v: k for k, v in new.items()}
    return docs.withColumnsRenamed(new), [new.get(c, c) for c in named], lambda out: out.withColumnsRenamed(back)
