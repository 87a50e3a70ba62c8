import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from almanac.llm import langid


def segmentations(word):
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def brute(word, prob, vocabulary):
    place = {p: i for i, p in enumerate(vocabulary.text)}
    total = 0
    for parts in segmentations(langid.START + word):
        q = 1.0
        for p in parts:
            q *= max(prob[place[p], 0] if p in place else 0, langid.FLOOR if len(p) == 1 else 0)
        total += q
    return math.log(total)


def test_forward_sums_all_segmentations():
    v = langid.pieces(langid.VOCABULARY)
    rng = np.random.default_rng(2)
    prob = rng.random((len(v.text) + 1, 1)) / len(v.text)
    prob[-1] = 0
    words = ["the", "a", "tionen", "über", "ñandú", "qzxqzx", "日本", "responsibilit"]
    got = langid.log_likelihoods(words, prob, v)[:, 0]
    assert np.allclose(got, [brute(w, prob, v) for w in words])
    counts = langid.expected_counts(["the"], np.array([0]), np.array([2.0]), prob, v)
    assert 2 <= counts.sum() <= 8  # two words of one to four pieces each


def test_words_of_all_lengths(monkeypatch):
    """Sums are the same however words are put together and wherever parts end; all of a word counts."""
    v = langid.pieces(langid.VOCABULARY)
    assert v.longest > 6
    rng = np.random.default_rng(3)
    prob = rng.random((len(v.text) + 1, 3)) / 50
    prob[-1] = 0
    words = ["responsibilit", "haus", "a", "日本ñq" * 3, "on"]
    lang, weight = np.array([0, 1, 2, 0, 1]), np.array([1.0, 2.0, 3.0, 1.0, 1.0])
    want = [[brute(w, prob[:, [k]], v) for k in range(3)] for w in words]
    counts = langid.expected_counts(words, lang, weight, prob, v)
    for batch, table in ((1 << 18, 1 << 19), (1, 1), (20, 200), (30, 3000)):
        monkeypatch.setattr(langid, "BATCH", batch)
        monkeypatch.setattr(langid, "TABLE", table)
        assert np.allclose(langid.log_likelihoods(words, prob, v), want)
        assert np.allclose(langid.expected_counts(words, lang, weight, prob, v), counts)
    monkeypatch.undo()
    x = langid.log_likelihoods(["haus" * 300, "haus" * 300 + "q", "haus" * 600], prob, v)
    assert np.isfinite(x).all() and (x[1] < x[0]).all() and (x[2] < x[1]).all()


def test_expected_counts_by_brute_force():
    v = langid.pieces(langid.VOCABULARY)
    place = {p: i for i, p in enumerate(v.text)}
    rng = np.random.default_rng(4)
    prob = rng.random((len(v.text) + 1, 1)) / 50
    prob[-1] = 0
    for word in ("there", "ñandú", "on"):
        want, total = np.zeros(len(v.text)), 0.0
        for parts in segmentations(langid.START + word):
            q = np.prod([max(prob[place[p], 0] if p in place else 0, langid.FLOOR if len(p) == 1 else 0) for p in parts])
            total += q
            for p in parts:
                if p in place:
                    want[place[p]] += q
        assert np.allclose(langid.expected_counts([word], np.array([0]), np.array([2.0]), prob, v)[:-1, 0], 2 * want / total)


def test_words(monkeypatch):
    text = "Ab² c½d ①Ⅷ e_f3G İx ΑΣ " + "long" * 9 + " 日本"
    want = ["ab", "c", "d", "e", "f", "g", "i", "x", "ας", "long" * 9, "日本"]
    assert [w for part in langid.words_of(text) for w in part] == want
    for size in range(1, 30):
        monkeypatch.setattr(langid, "PART", size)
        assert [w for part in langid.words_of(text) for w in part] == want


def test_query_by_brute_force(spark, tmp_path):
    """lang_pred and score of the registered query on short texts, by all segmentations of every word under the fitted model."""
    from almanac.llm.queries import op2_language_id

    rnd = np.random.default_rng(7)
    vocabularies = {"en": "the house and a garden of our old town".split(), "de": "das haus und der garten über uns".split(), "fr": "la maison et le jardin été".split()}
    rows = [(i, " ".join(rnd.choice(vocabularies[lang], 6)), lang) for i in range(120) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, "the haus", "en"), (901, "été 12 über", None), (902, "qzx", None), (903, "12 !", "de"), (904, None, "fr"), (905, "House", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    langs, prob = langid.fit(docs.where(~langid.held_out("doc_id")))
    v = langid.pieces(langid.VOCABULARY)
    got = {r.doc_id: r for r in op2_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    known = {}
    for i, text, _ in rows:
        words = [w for part in langid.words_of(text or "") for w in part]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        for w in words:
            known.setdefault(w, np.array([brute(w, prob[:, [k]].astype(np.float32).astype(float), v) for k in range(len(langs))]))
        logs = sum(known[w] for w in words)
        assert got[i].lang_pred == langs[int(logs.argmax())]
        assert math.isclose(got[i].score, 1 / np.exp(logs - logs.max()).sum(), rel_tol=1e-6)


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    clash = langid.predict(spark.createDataFrame([(1, "das haus", "x")], "doc_id long, text string, _text string"), (["de"], np.ones((len(langid.pieces(langid.VOCABULARY).text) + 1, 1)) / 9))
    assert clash.columns == ["doc_id", "text", "_text", "lang_pred", "score"] and clash.first().lang_pred == "de" and clash.first()["_text"] == "x"
    rows = [(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "123 ²½① !!", None, 1), (None, "und der garten", None, 1), (103, "haus" * 5000, None, 1), (1, "the house and the garden", "en", 1)]
    out = langid.identify(spark.createDataFrame(rows, schema))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert got[None].lang_pred == "de" and got[None].held_out is False
    assert got[103].lang_pred == "de" and got[1].lang_pred == "en"
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None, 1)], schema)
    assert langid.identify(unlabelled).first().lang_pred == "und"
