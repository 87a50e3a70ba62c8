import random
import re

import numpy as np

from almanac.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
AZ = {i: i + 32 for i in range(65, 91)}


def expected(rows, min_docs=3, top=200):
    """Brute force over dense tables; rows are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, TERM.findall(t.translate(AZ))) for x, s, t in rows if x == lang]
        docs = {}
        for _, t in own:
            for x in set(t):
                docs[x] = docs.get(x, 0) + 1
        kept = [x for x, n in docs.items() if n >= min_docs]
        sides = {s: {} for s, _ in own}
        everything = {}
        for s, t in own:
            for x in t:
                if docs[x] >= min_docs:
                    sides[s][x] = sides[s].get(x, 0) + 1
                    everything[x] = everything.get(x, 0) + 1
        share = lambda c: {x: 1 + 10**9 * (c.get(x, 0) + 1) // (sum(c.values()) + len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in sides.items()}, share(everything)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sides:
            parts = {"pair": [(r, sum(f(p[s][x], p[r][x]) for x in kept)) for r in sides if r != s], "term": [(x, f(p[s][x], q[x])) for x in sides[s] if p[s][x] > q[x]]}
            for part, values in parts.items():
                values.sort(key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(values, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(seed, n=240):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "日本語", "naïve", "Z"]
    text = lambda s: rnd.choice([" ", "-", "1", "\x7f", "\n"]).join(rnd.choice(words[: 20 + 7 * s]) for _ in range(rnd.randint(0, 60)))
    rows = [(rnd.choice(["en", "de", None]), f"s{s}" if s else None, text(s)) for s in (rnd.randrange(7) for _ in range(n))]
    return [*rows, ("fr", "a", "one two"), ("fr", "b", "three"), ("xx", "only", "x x x"), ("en", "silent", ""), ("en", "silent", None), ("en", "digits", "1 2 3 [ ]"), ("de", "s1", "wAA waa"), ("de", "s1", "wAA waa")]


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert result(divergence.divergences(df)) == expected(rows)
    assert result(divergence.divergences(df, min_docs=1, top=3)) == expected(rows, 1, 3)


def test_blocks_shards_and_long_texts(spark, monkeypatch):
    """Many small blocks and shards, joins without broadcast, and texts in pieces give the same."""
    from almanac.llm import scratch

    rows = [*corpus(2), ("en", "s1", "waa É " * 3000), ("en", "s2", "q" * 4000 + " waa")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = expected(rows)
    for name, value in (("BLOCK", 7), ("MOST", 9), ("ROWS", 2)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(scratch, "BROADCAST_IDS", 0)
    assert result(divergence.divergences(df)) == want


def test_pieces_of_one_text(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    raw = np.frombuffer(("ab é日本 cd 12 " * 40 + "x" * 500 + " ab").encode(), np.uint8)
    cuts = divergence._cuts(raw, 0, len(raw))
    found = [x for a, b in zip(cuts, cuts[1:]) for x in divergence.terms(raw, np.array([a, b]))[0].to_pylist()]
    assert len(cuts) > 10 and found == TERM.findall(raw.tobytes().decode())


def test_accumulated_rows_are_dense_sums(monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 16)
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((6, 50)) < 0.3, rng.integers(2, 10**8, (6, 50)), 0)
    dense[:, 0], dense[5] = 7, 0  # a term of nearly all groups, and a group without terms
    zero = rng.integers(1, 1000, 6)
    group, term = np.nonzero(dense)
    full = np.where(dense > 0, dense, zero[:, None])
    present = full[:, (dense > 0).any(axis=0)]
    want = np.array([[((a - b) ** 2 // b).sum() for b in present] for a in present])
    shuffled = rng.permutation(len(term))
    got = divergence.accumulate(term[shuffled] * 10 + 3, group[shuffled], dense[group, term][shuffled], zero, np.arange(6))
    assert (got == want).all()
    assert (divergence.accumulate(term[:0], group[:0], term[:0], zero, np.arange(6)) == 0).all()


def test_clashing_names_and_empty_tables(spark):
    inner = "n docs term term_id gid p q zero shard shards block blocks task value item part rank v total own_n".split()
    rows = [("l", "s", "a b a", *inner), ("l", "r", "a", *inner), ("l", "r", "a c", *inner)]
    df = spark.createDataFrame(rows, f"lang string, source string, text string, {', '.join(f'{c} string' for c in inner)}")
    assert result(divergence.divergences(df)) == expected([r[:3] for r in rows])
    assert divergence.divergences(df.limit(0)).collect() == []
