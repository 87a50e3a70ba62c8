import random

import sentencepiece

from almanac.llm import fsttok

PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=fsttok.MODEL)


def sample(seed, n):
    rnd = random.Random(seed)
    pieces = [p for p in fsttok.unit_counts(fsttok.MODEL).transducer.scores if len(p) > 1]
    odd = [" ", "  ", "   ", "\n", "\t", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x0A>", "é", "日本", "🎉", "\x00", "a", "the", "ing"]
    out = []
    for _ in range(n):
        out.append("".join(rnd.choice(odd) if rnd.random() < 0.3 else rnd.choice(pieces).replace("▁", rnd.choice([" ", "", " "])) for _ in range(rnd.randint(0, 30))))
    return out


def test_transducer_against_library():
    counts = fsttok.unit_counts(fsttok.MODEL)
    for t in [*sample(1, 3000), "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "   lead", "trail   ", "Ünïcödé ß"]:
        assert fsttok.count_tokens(t, counts) == len(PROCESSOR.encode(t)), t


def test_maps_compose_anywhere(monkeypatch):
    """Maps of chunks cut anywhere give the count of the whole; states that a map lacks are named and can be added."""
    t, rnd = fsttok.unit_counts(fsttok.MODEL).transducer, random.Random(5)
    texts = [*sample(2, 300), "a" * 400, "ab" * 200, "=" * 333, "0123456789abcdef" * 20]
    for lead in (fsttok.LEAD, 3, 0):
        misses = 0
        for text in texts:
            marked = fsttok.SPACE + text.replace(" ", fsttok.SPACE)
            cuts = sorted({0, len(marked), *(rnd.randint(0, len(marked)) for _ in range(rnd.randint(0, 6)))})
            spans = list(zip(cuts, cuts[1:]))
            maps = [(i, fsttok.chunk_map(marked[max(0, a - lead) : a], marked[a:b], t)) for i, (a, b) in enumerate(spans)]
            while True:
                half = [(m[0][0], fsttok.compose(m)) for m in (maps[:2], maps[2:]) if m]
                x, y = fsttok.follow(half, next(iter(maps[0][1])))
                if isinstance(x, str):
                    break
                misses += 1
                maps[x][1].update(fsttok.chunk_map("", marked[slice(*spans[x])], t, (y,)))
            assert y == len(PROCESSOR.encode(text)) if text else True, text
        assert misses > 100 if lead < 4 else misses == 0


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(fsttok, "STATES", 50)
    counts = fsttok.UnitCounts(fsttok.MODEL)
    for text in sample(9, 200):
        assert fsttok.count_tokens(text, counts) == len(PROCESSOR.encode(text))
        assert len(counts.transducer.moves) < 400


def test_long_and_odd_rows(spark):
    texts = [*sample(3, 40), "x" * 500, "word " * 200, "word " * 200, None, ""]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "null id", "s", 1), (3, "same id", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, no string, n_tokens int")
    out = fsttok.token_counts(df, limit=20, chunk=50)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(PROCESSOR.encode(r[1] or "")), n > 20) for r in rows), key=repr)
    assert got == want
    assert fsttok.token_counts(df.limit(0)).collect() == []


def test_states_that_maps_lack(spark, monkeypatch):
    monkeypatch.setattr(fsttok, "LEAD", 0)
    monkeypatch.setattr(fsttok, "FAN", 3)
    texts = ["".join(random.Random(i).choice("abcdefgh0123") for _ in range(900)) for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in fsttok.token_counts(df, chunk=100).collect()} == {i: len(PROCESSOR.encode(t)) for i, t in enumerate(texts)}


def test_text_without_spaces_in_parallel(spark):
    """Every chunk of 32,768 characters is a row of its own, with a map of a few states instead of its text."""
    text = "".join(random.Random(3).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    t = fsttok.unit_counts(fsttok.MODEL).transducer
    m = fsttok.chunk_map(text[1000 - fsttok.LEAD : 1000], text[1000 : 1000 + fsttok.CHUNK], t)
    assert len(m) <= fsttok.SHIFTS and len(str(m)) < 10_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert fsttok.token_counts(df).first().n_tokens == len(PROCESSOR.encode(text))


def test_neighbours_by_their_merges():
    """Two pieces may stand side by side if merging both together, by definition, gives them again."""

    def merged(text):
        parts = list(text)
        while True:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := t.scores.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    t, rnd = fsttok.Transducer(), random.Random(8)
    pieces = sorted(t.scores)
    by_first = {}
    for p in pieces:
        by_first.setdefault(p[0], []).append(p)
    repeats = [p for p in pieces if len(set(p)) == 1]
    cases = [(a, b) for a in repeats for b in repeats if a[0] == b[0]]
    while len(cases) < 20_000:
        a = rnd.choice(pieces)
        cases.append((a, rnd.choice(by_first.get(rnd.choice("aeinorst▁.0"), pieces))))
    fits = [t._fit(a, b) for a, b in cases if merged(a) == [a]]
    assert fits == [merged(a + b) == [a, b] for a, b in cases if merged(a) == [a]]
    assert 1000 < sum(fits) < len(fits) - 1000
    assert all(t._fit(None, p) == (merged(p) == [p]) for p in pieces[::50])


def test_what_no_piece_crosses_is_forgotten():
    """Words before a comma lead to one state, so that few are compiled."""
    t = fsttok.Transducer()
    assert len({t.run(t.start, f"▁{w},")[0] for w in ("word", "other", "Straße", "a", "")}) <= 2  # only the bare space mark may matter
    assert t.run(t.start, "▁word,")[0] == t.run(t.start, ",")[0]


def test_chunks_take_whole_units_from_counts(monkeypatch):
    counts, rnd = fsttok.UnitCounts(fsttok.MODEL), random.Random(6)
    t = counts.transducer
    for text in [*sample(4, 400), " a", "a ", "a  b", "   ", "a b", "  a  "]:
        if not text:
            continue
        marked = fsttok.SPACE + text.replace(" ", fsttok.SPACE)
        cuts = sorted({0, len(marked), *(rnd.randint(0, len(marked)) for _ in range(3))})
        maps = [(i, fsttok.chunk_map(marked[max(0, a - fsttok.LEAD) : a], marked[a:b], t, (), counts)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert fsttok.follow(maps, next(iter(maps[0][1])))[1] == len(PROCESSOR.encode(text)), text
    read = []
    run = t.run
    monkeypatch.setattr(t, "run", lambda state, text: read.append(len(text)) or run(state, text))
    text = "".join(f"▁{w}" for _ in range(1000) for w in ("some", "words,", "again"))
    fsttok.chunk_map("", text, t, (), counts)
    assert sum(read) < 100
    # Counts and states may begin anew amid a chunk.
    monkeypatch.setattr(fsttok, "KEPT", 3)
    monkeypatch.setattr(fsttok, "STATES", 20)
    marked = "▁" + "▁".join(str(rnd.random()) for _ in range(300))
    cuts = range(0, len(marked), 500)
    maps = [(i, fsttok.chunk_map(marked[max(0, i - fsttok.LEAD) : i], marked[i : i + 500], t, (), counts)) for i in cuts]
    assert fsttok.follow(maps, next(iter(maps[0][1])))[1] == len(PROCESSOR.encode(marked[1:].replace("▁", " ")))


def test_long_units_are_not_kept():
    counts = fsttok.UnitCounts(fsttok.MODEL)
    texts = ["x" * 5000, "日本" * 3000, "short ones"]
    assert [fsttok.count_tokens(t, counts) for t in texts] == [len(PROCESSOR.encode(t)) for t in texts]
    assert sorted(counts) == ["ones", "short"]
