"""Callers' columns named like the operators' inner ones, in any case, come back with their values."""

import pytest
from pyspark.sql import functions as F

from almanac.llm import decontam, fsttok, langid, licenses, quality, suffix, urlfilter

LONG = " ".join(f"word{i} {i * i}" for i in range(40))


def docs(spark, inner, text="text"):
    names = [*inner, *(n.upper() for n in inner if n.upper() != n)]
    names = [n for i, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:i]} and n.lower() not in (text.lower(), "doc_id")]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate([LONG, LONG, None, "", "All rights reserved."])]
    df = spark.createDataFrame(rows, f"doc_id long, `{text}` string, {', '.join(f'`{n}` string' for n in names)}")
    return df, names


def held(out, names):
    assert [c for c in out.columns if c in names] == names
    return {r.doc_id: r for r in out.collect() if all(r[n] == f"{n}{r.doc_id}" for n in names)}


WORDS = ["_t", "_W", "_l", "_h", "_g", "_S", "_r", "_p", "_q", "_f", "_a", "_b", "a", "b", "d", "T", "gone", "_text", "_bad", "_url", "_u", "_best", "_k", "no", "lead", "chunk", "map", "n", "s", "e", "q", "h", "g", "c", "k", "row", "bucket", "bytes", "want", "ids", "key"]


@pytest.mark.parametrize("text", ["text", "_t", "t", "_text"])
def test_operators_on_texts(spark, text):
    df, names = docs(spark, WORDS, text)
    q = held(quality.judge(quality.ledger(df, text)), names)
    assert {i: r.n_words for i, r in q.items()} == {0: 80, 1: 80, 2: 0, 3: 0, 4: 3}
    s = held(licenses.scan(df, text), names)
    assert {i: r.license for i, r in s.items()} == {0: None, 1: None, 2: None, 3: None, 4: "all-rights-reserved"}
    r = held(suffix.remove_repeats(df, text=text), names)
    assert {i: x.n_removed for i, x in r.items()} == {0: 0, 1: len(LONG), 2: 0, 3: 0, 4: 0}
    items = spark.createDataFrame([(1, LONG[20:90])], "item_id long, text string")
    assert sorted(held(decontam.without_leaks(df, items, text=text), names)) == [2, 3, 4]
    t = held(fsttok.token_counts(df, text=text, chunk=64), names)
    assert t[0].n_tokens == t[1].n_tokens > 80 and t[2].n_tokens == t[3].n_tokens == 0
    model = langid.fit(df.select("doc_id", F.col(text).alias("text"), F.lit("x").alias("lang")))
    assert {i: x.lang_pred for i, x in held(langid.predict(df, model, text), names).items()} == {0: "x", 1: "x", 2: "und", 3: "und", 4: "x"}


@pytest.mark.parametrize("url", ["url", "_url", "_u"])
def test_operators_on_urls(spark, url):
    names = [n for n in ["_url", "_u", "_best", "action", "digest", "short", "_host", "_h"] if n != url]
    df = spark.createDataFrame([(i, u, *(f"{n}{i}" for n in names)) for i, u in enumerate(["http://a.net/fr/x", None])], f"doc_id long, `{url}` string, {', '.join(f'`{n}` string' for n in names)}")
    out = held(urlfilter.judge_urls(df, urlfilter.rules_table(spark), url=url), names)
    assert {i: (r.host, r.verdict) for i, r in out.items()} == {0: ("a.net", "block"), 1: ("", "allow")}
