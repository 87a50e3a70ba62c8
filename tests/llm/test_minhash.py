import random

import numpy as np
from pyspark.sql import functions as F

from almanac.llm import minhash
from almanac.llm.components import components


def words(t):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]


def brute(rows, k):
    """doc_id -> (set size, component); rows with one text per id."""
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        old = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if old == comp:
            return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed, groups, noise):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, noise)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((i * 5 + 2, rnd.choice([" ", "  ", "\n", "\t"]).join(w)))
            i += 1
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(1, 40, 3) + [(1, None), (3, ""), (4, " \n\t "), (6, "One"), (8, "one"), (9, "ONE two"), (11, "one  two"), (13, "x " * 4000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k in (2, 5):
        out = {r.doc_id: r for r in minhash.near_duplicates(df, k=k).collect()}
        want = brute(rows, k)
        assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == want
        assert all(r.kept == (i == r.component_id) for i, r in out.items())


def test_template_family(spark):
    """Many texts that share most of a passage: stars in bands leave them apart, the exact search must not."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"o{rnd.randint(0, 30)}" for _ in range(rnd.randint(8, 16))]
        rows.append((i + 1, " ".join(passage + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def template_family(n):
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    return [(i + 1, " ".join(passage + [f"o{rnd.randint(0, 30)}" for _ in range(rnd.randint(8, 14))])) for i in range(n)]


def test_order_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), k=2).collect()
        assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == [(1, 1, 19), (1, 1, 19), (2, 1, 20), (3, 1, 20)]


def test_large_groups_and_split_tokens(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR", 3)
    monkeypatch.setattr(minhash, "SPLIT", 4)
    rows = corpus(5, 25, 3) + [(i + 9001, t) for i, t in template_family(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2).collect()} == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "B", " ", "  ", "longer", "é", "\n"]) for _ in range(rnd.randint(1, 80))) for _ in range(60)] + ["x" * 300, " " * 90, "a" * 50 + " " + "b" * 49]
    monkeypatch.setattr(minhash, "PIECE", 1 << 12)
    powers = minhash.Powers(1 << 12)
    for t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        words, at = minhash.word_hashes(buf, np.array([0, len(buf)]), powers)
        for k in (1, 2, 5):
            want = minhash.shingle_sets(words, at, k)[0]
            for piece in (7, 16, 50):
                monkeypatch.setattr(minhash, "PIECE", piece)
                assert (minhash.long_set(buf, k, powers) == want).all()
                if len(want):
                    monkeypatch.setattr(minhash, "PIECE", 1 << 12)
                    whole = minhash.signatures([want])
                    monkeypatch.setattr(minhash, "PIECE", piece)
                    assert (minhash.signatures([want]) == whole).all()


def test_edges(spark):
    schema = "doc_id long, text string, n int, component_id string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "x"), (7, "a b c d e f", 1, "x")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(None, None, True), (None, None, True), (2, 2, True), (2, 2, True), (7, 2, False)], key=repr)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(base[:700]), np.unique(base[200:])
    s = minhash.signatures([a, b])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(df.where(F.lit(False))).collect() == []
