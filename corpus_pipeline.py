"""A training-corpus pipeline over documents: filter, deduplicate, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from almanac.llm import bpe, decontam, minhash, quality, suffix
from almanac.llm.scratch import discard, join_ids, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps. A null text has no words and goes."""
    return quality.judge(quality.ledger(docs)).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (5-word shingles, similarity 0.8).

    Rows that repeat an id are one document, of which the first row by order stays; rows with a null id all stay.
    """
    kept = minhash.near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    known = join_ids(docs, written(kept, "kept"), ["doc_id"], "left_semi").select(*docs.columns)
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        some = join_ids(known, repeated, ["doc_id"], "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id")
        one = some.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
        known = join_ids(known, repeated, ["doc_id"], "left_anti").select(*docs.columns).unionByName(one)
    return known.unionByName(docs.where("doc_id is null"))


@F.pandas_udf(StringType())
def _text(kept):
    # A removed run may begin or end within a character; what is left of such a character goes too.
    return kept.map(lambda b: bytes(b).decode(errors="ignore"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of later copies of strings of 100 bytes and more; n_chars is that of the text left."""
    out = suffix.remove_repeats(docs, length=100).withColumn("text", _text("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within 5 edits per 100 characters."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", byte_bpe),
]

#: BPE and edit distances have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
