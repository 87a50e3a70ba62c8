import pytest
from pyspark.sql import functions as F

from almanac.llm.queries import ORACLE, QUERIES

from ..harness import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    compare(spark, con, SF, QUERIES[name], ORACLE[name])


def test_token_counts_and_ids_on_all_documents(spark):
    import hashlib

    import public_tokenizers
    import sentencepiece
    import tiktoken

    from almanac.llm import bpe, fsttok

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=fsttok.MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), len(sp.encode(t))) for i, t in docs.items()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.MULTILINGUAL), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in QUERIES["op3_byte_bpe"](spark, SF).collect()}
    assert got == {i: (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()) for i, t in docs.items() for e in [enc.encode_ordinary(t)]}


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES["op2_language_id"](spark, SF)
    assert out.count() == docs.count()
    right = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
