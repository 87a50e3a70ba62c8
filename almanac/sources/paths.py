"""Where jobs may leave files that the whole cluster sees."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which goes when the driver ends.

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
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder: a plan that goes on from here doesn't repeat them."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to path has ended well, or mark() was called for it."""
    return exists(spark, f"{path}/_SUCCESS")


def mark(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, f"{path}/_SUCCESS")
    fs.create(p, True).close()


def part_names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Sorted names below path that begin so; none where path isn't there."""
    fs, p = _at(spark, path)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def concatenate(spark: SparkSession, pieces: list[str | tuple[str]], path: str) -> None:
    """A file at path of texts and of the part files of folders (as tuples of one), in the order of their names. It takes its place when it is whole; bytes pass by a buffer of a megabyte."""
    fs, target = _at(spark, path)
    jvm = spark._jvm
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(new, True)
    for piece in pieces:
        if isinstance(piece, str):
            out.write(bytearray(piece.encode()))
            continue
        for name in part_names(spark, piece[0], "part-"):
            source = fs.open(jvm.org.apache.hadoop.fs.Path(f"{piece[0]}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    out.close()
    fs.delete(target, True)
    fs.rename(new, target)
