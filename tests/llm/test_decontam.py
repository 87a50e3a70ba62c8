import random

from almanac.llm import decontam


def best_match(pattern, text, k):
    """Plain dynamic programming, free start and end in the text."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best if best[0] <= k else None


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], ["q"], [s[i], "z"]])
    return "".join(s)


def test_myers():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 80)))
        t = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 60))) + edited(rnd, p, rnd.randint(0, 4)) + "ba"
        k = rnd.randint(0, 6)
        assert decontam.myers(p, t, k) == best_match(p, t, k)


def test_segments_of_long_texts(monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(decontam, "SEGMENT", 70)
    items = tuple((i, "".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 90)))) for i in range(30))
    search = decontam.Searcher(items, 5)
    for _ in range(30):
        text = "".join(rnd.choice("abc d") for _ in range(200)) + "".join(edited(rnd, rnd.choice(items)[1], rnd.randint(0, 3)) for _ in range(6))
        want = {(i, *m) for i, x in items if (m := best_match(x, text, decontam.budget(x)))}
        assert set(search(text)) == want and len(want) > 3


def test_normalise():
    for t in ("a  b", "\ta b\n", "a\x1cb \u3000c", " ", "x y", "a \n\nB", None):
        assert decontam.normalise(t) == " ".join((t or "").lower().split())


def test_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeghi") for _ in range(rnd.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(rnd.randint(8, 40))) for i in range(12)] + [(20, "abe"), (25, "q"), (21, None), (22, ""), (23, "  ")]
    items.append((24, items[0][1].upper()))
    docs = []
    for i in range(60):
        t = say(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice([" ", "\n\n", ". "]) + edited(rnd, rnd.choice(items[:12])[1], rnd.randint(0, 12)) + " " + say(5)
        docs.append((i, t, "s"))
    docs += [(100, None, "s"), (101, "", "s"), (None, items[1][1], "s"), (5, docs[5][1], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(df, it).collect()), key=repr)
    want = []
    for d, t, _ in docs:
        for i, x in items:
            x = decontam.normalise(x)
            if x and (m := best_match(x, decontam.normalise(t), decontam.budget(x))):
                want.append((d, i, m[0]))
    assert got == sorted(want, key=repr) and len(want) > 30
    clean = decontam.without_leaks(df, it)
    assert clean.columns == df.columns
    bad = {d for d, _, _ in want if d is not None}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _, _ in docs if d not in bad), key=repr)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 30)
    it = spark.createDataFrame([(1, "first item of the benchmark"), (2, "second item of the benchmark")], "item_id long, text string")
    df = spark.createDataFrame([(7, "x first item of the benchmark, second item of the benchmark y")], "doc_id long, text string")
    assert sorted((r.item_id, r.distance) for r in decontam.leaks(df, it).collect()) == [(1, 0), (2, 0)]
    assert decontam.leaks(df, it.limit(0)).collect() == []
    assert decontam.leaks(df.limit(0), it).collect() == []
