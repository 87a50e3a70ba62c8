import random

from almanac.llm import lines

SPACE = " \t\n\v\f\r"
AZ = {i: i + 32 for i in range(65, 91)}


def expected(rows, min_chars, min_docs):
    """Brute force; rows are (doc_id, text)."""
    key = lambda x: x.strip(SPACE).translate(AZ)
    ident = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(ident(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == ident(i)]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = ["a common line of some length " + str(i) * 12 for i in range(6)] + ["short", "", " ", "\t", "É" * 40, "é" * 40, "İstanbul " * 6, "x" * 39, "x" * 40]
    dress = lambda x: rnd.choice(["", " ", "\t\r", " "]) + (x.upper() if rnd.random() < 0.3 and x.isascii() else x) + rnd.choice(["", "  ", "\x0b"])
    rows = [(i, "\n".join(dress(rnd.choice([*pool, f"own line {i} " * 6])) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join([pool[0]] * 4)), (103, "\n".join([pool[0]] * 4)), (103, pool[1] + "\nother text of the same id"), (None, pool[0]), (None, pool[1]), (-5, "line\n" * 5000 + pool[2])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, least in ((5, 40), (2, 40), (3, 1), (1, 40)):
        assert result(lines.drop_repeated_lines(df, min_chars=least, min_docs=n)) == expected(rows, least, n)


def test_a_line_of_every_document_and_joins_without_broadcast(spark, monkeypatch):
    from almanac.llm import scratch

    rows = [(i, f"text {i}\n" + "what every document has, word for word" * 2 + f"\nend {i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = expected(rows, 40, 5)
    assert result(lines.drop_repeated_lines(df)) == want and sum(r[2] for r in want) == 2999
    monkeypatch.setattr(scratch, "BROADCAST_IDS", 0)
    assert result(lines.drop_repeated_lines(df)) == want


def test_clashing_names_and_empty_tables(spark):
    inner = "row d t pos line key last docs one drops parts n_lines n_dropped kept often".split()
    cells = tuple(f"c{i}" for i in range(len(inner)))
    df = spark.createDataFrame([(1, "a\nb", *cells), (1, "a\nb", *cells)], f"doc_id long, text string, {', '.join(f'{c} string' for c in inner)}")
    out = lines.drop_repeated_lines(df)
    kept = [c for c in inner if c not in lines.ADDED]
    assert out.columns == ["doc_id", "text", *kept, *lines.ADDED]
    assert all(tuple(r[c] for c in kept) == tuple(x for x, c in zip(cells, inner) if c in kept) and (r.n_lines, r.n_dropped, r.kept) == (2, 0, "a\nb") for r in out.collect())
    assert lines.drop_repeated_lines(df.limit(0)).collect() == []
    other = df.select("doc_id", df["text"].alias("body"))
    assert result(lines.drop_repeated_lines(other, text="body")) == [(1, 2, 0, "a\nb")] * 2
