import hashlib
import random
import zlib

import pytest

from almanac.llm import runs
from almanac.llm.queries import op13_periodic_runs


def brute_runs(w, least, times):
    """Islands of w[i] == w[i + p]; of equal stretches that with the smallest period counts."""
    n, found = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return {(s, n, p) for (s, n), p in found.items()}


def longest_lyndon(w):
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def texts(seed, n, most):
    rnd = random.Random(seed)
    for _ in range(n):
        k, w = rnd.randint(1, 4), []
        while len(w) < rnd.randint(0, most):
            w += [rnd.randrange(k) for _ in range(rnd.randint(1, 6))] * rnd.choice([1, 1, 2, 3, 4, 5, 9])
        yield [sorted(set(w)).index(x) for x in w]


def test_groups_are_those_of_longest_lyndon_words():
    for w in texts(1, 300, 24):
        size, group = runs.lyndon_groups(w)
        assert size == longest_lyndon(w)
        words = {}
        for i, (n, g) in enumerate(zip(size, group)):
            assert words.setdefault(g, w[i : i + n]) == w[i : i + n]
        assert len({tuple(x) for x in words.values()}) == len(words)


@pytest.mark.parametrize("least, times", [(6, 4), (1, 2), (2, 2), (6, 3), (12, 5)])
def test_runs_against_brute_force(least, times):
    for w in texts(least * 10 + times, 300, 120):
        want = brute_runs(w, least, times)
        assert runs.runs_in(w, least, times) == want
        assert set(runs.word_runs([b"w%d" % x for x in w], least, times, runs.window_size(least, times))) == want


def test_words_that_repeat_without_runs():
    """Fibonacci and Thue-Morse words: many squares, no fourth power; and one run over a whole long text."""
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    assert runs.runs_in(b, 6, 4) == runs.runs_in(thue, 6, 4) == set()
    assert runs.runs_in(b[:300], 2, 2) == brute_runs(b[:300], 2, 2)
    assert runs.runs_in([0] * 100_000, 6, 4) == {(0, 100_000, 1)}


def expected(doc_id, text):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = sorted(brute_runs(w, 6, 4), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(((-n, s, p) for s, n, p in found), default=None)
    row = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *row, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_on_hand_made_texts(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["a", "b", "A", "é", "日本", "x y", "long"])
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(word() for _ in range(rnd.randint(0, 200)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a " * 3000), (1004, "a b " * 9 + "c"), (1004, "a b " * 9 + "c"), (None, "x y " * 8), (-7, "one two three"), (1005, " ".join(str(i) for i in range(30_000)) + " end" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 15


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 8, "r", "c", 5)], "doc_id long, text string, runs string, collapsed string, row int")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "row", "runs", "collapsed"]
    r = out.first()
    assert (r.row, [tuple(x) for x in r.runs], r.collapsed) == (5, [(0, 16, 2)], "a b")
    assert runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(df, min_exponent=1)
