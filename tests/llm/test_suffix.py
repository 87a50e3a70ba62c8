import hashlib
import random

import numpy as np

from almanac.llm import suffix


def removed(rows, length):
    """Brute force over all windows; rows are (doc_id, text), ids are distinct."""
    first, out = {}, {}
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    for i, raw in docs:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if first.setdefault(w, (i, s)) != (i, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(20, 80))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        text = parts[0] + rnd.choice(passages) + parts[1] + rnd.choice([*passages, ""]) + parts[2]
        rows.append((i * 3 + 1, text))
    rows += [(10_000 + i, rows[i][1]) for i in range(5)]
    rows += [(5, "x" * 700), (8, "ab" * 300 + "x" * 150), (9, ""), (11, None), (14, "short"), (17, rows[0][1][:99]), (20, rows[0][1][:100])]
    rnd.shuffle(rows)
    return rows


def test_lpf_against_brute_force():
    rnd = random.Random(3)
    for _ in range(30):
        text = np.array([rnd.choice(b"ab") for _ in range(60)], np.uint8)
        starts = np.arange(50)
        order, lcp = suffix.suffix_order(text, starts, 10)
        lpf = suffix.longest_previous_factor(order, lcp, starts)
        for i in starts:
            common = [next((k for k in range(10) if text[i + k] != text[j + k]), 10) for j in range(i)]
            assert lpf[i] == max(common, default=0)
        assert (suffix.repeated_starts(text, starts, starts, 10) == (lpf >= 10)).all()


def test_matches_brute_force(spark):
    rows = corpus(1, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(suffix.remove_repeats(df)) == removed(rows, 100)


def test_small_pieces_and_hot_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 900)
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "BUCKET", 5)
    rows = corpus(2, 50)
    # functions made here carry the small sizes to the workers
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(suffix.remove_repeats(df)) == removed(rows, 100)


def test_a_gram_in_10_000_surroundings(spark):
    """More than a bucket takes: dealt out by longer common strings, as often as needed."""
    rnd = random.Random(11)
    line = "".join(rnd.choice("abcdefgh") for _ in range(120))
    near = ["".join(rnd.choice("xyz") for _ in range(60)) for _ in range(40)]
    rows = [(i, (rnd.choice(near) if i % 3 else f"{i:060d}") + line + (rnd.choice(near) if i % 2 else f"{i:060d}")) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix.remove_repeats(df)) == removed(rows, 100)


def test_halves_keep_equal_windows_together():
    """Whatever lies around it, a window's key at each level depends on its own bytes and the gram's place."""
    rnd = random.Random(2)
    core = bytes(rnd.choice(b"ab") for _ in range(168))
    rows = [(1, 0, 0, 68, core)] + [(1, 0, 0, 68 - a, core[a : len(core) - b]) for a, b in ((5, 60), (30, 20), (68, 0), (0, 68), (40, 3))]
    for level in range(suffix.LEVELS):
        rows = [(k, level + 1, h, o, x) for key, _, piece, off, raw in rows for k, h, _, o, x in suffix.halves(key, level, piece, off, raw, 100)]
        keys, seen = {}, set()
        for key, _, _, off, raw in rows:
            for w in range(len(raw) - 99):
                assert keys.setdefault((off - w, raw[w : w + 100]), key) == key
                seen.add(off - w)
        assert seen == set(range(69))
    assert all(len(raw) == 100 for *_, raw in rows)


def test_edges(spark):
    schema = "doc_id long, text string, kept string, d int, extra int"
    empty = spark.createDataFrame([], schema)
    assert suffix.remove_repeats(empty).collect() == []
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(100))
    rows = [(1, long, "k", 1, 7), (1, long, "k", 1, 7), (2, long, None, None, None), (None, long, None, None, None), (None, None, None, None, None)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "extra", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in out.collect())
    n = len(long)
    assert got == [(-1, 0, 0), (-1, n, 0), (1, n, n), (1, n, n), (2, n, n)]
