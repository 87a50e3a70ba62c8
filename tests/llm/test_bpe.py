import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import public_tokenizers
import tiktoken

from almanac.llm import bpe

TEXTS = ["", None, "plain words, don't stop", "  two  spaces\n\n\tand tabs \x1c\x1d \x85 end ", "éàü ñ 日本語 🎉👍🏽", "1234567 v2.0!!", "x" * 3000, " ", "\n", "don't 'LL it's", "　wide line", "a\x00b", "ﬁ ǅ ١٢"]


def truth():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.MULTILINGUAL), special_tokens={})


def test_against_library(spark):
    t = truth()
    rows = [(i, x) for i, x in enumerate(TEXTS * 3)] + [(None, "no id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = bpe.encode(df, block=200)
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in out.collect()), key=repr)
    want = sorted(((i, len(e), e) for i, x in rows for e in [t.encode_ordinary(x or "")]), key=repr)
    assert got == want
    back = bpe.decode(out).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in back), key=repr) == sorted(((i, x or "") for i, x in rows), key=repr)


def test_parts_of_long_texts(monkeypatch):
    seen, split = defaultdict(count().__next__), bpe._splitter(public_tokenizers.PATTERN)
    text = "".join(x or "" for x in TEXTS) * 3
    want = split.findall(text)
    for size in (3, 10, len(want), 10_000):
        monkeypatch.setattr(bpe, "PART", size)
        codes = bpe._codes(text, split, seen).tolist()
        words = list(seen)
        assert [words[c] for c in codes] == want and bpe._codes("", split, seen).tolist() == []
    ids = np.arange(20, dtype=np.int32)
    whole = bpe._digests(bpe.MULTILINGUAL)([ids, ids[:0]])
    monkeypatch.setattr(bpe, "PART", 7)
    assert bpe._digests(bpe.MULTILINGUAL)([ids, ids[:0]]) == whole and whole["ids_sha256"][0] == hashlib.sha256(",".join(map(str, range(20))).encode()).hexdigest()


def test_few_kept_words(spark, monkeypatch):
    encode, known = bpe._encode(bpe.MULTILINGUAL), bpe.KEPT
    words = [x.encode() for x in public_words()]
    batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array([1]), bpe.pa.array([0]), bpe.pa.array([b""]), bpe.pa.array([bpe._pack_words(words * 2)])], names=["block", "bucket", "places", "words"])
    plain = [b.to_pydict() for b in encode([batch])]
    monkeypatch.setattr(bpe, "KEPT", 2)
    assert [b.to_pydict() for b in encode([batch])] == plain and known > 2


def public_words():
    return bpe._splitter(public_tokenizers.PATTERN).findall(" ".join(x or "" for x in TEXTS))


def test_digests_and_edges(spark):
    t = truth()
    rows = [(i, x, 1, "y") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    for r in bpe.encode_digests(df).collect():
        ids = t.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0)).collect() == []


def test_blocks_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    out = bpe.encode(df)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
