import hashlib
import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken

from almanac.llm import bpe, decontam

from .test_decontam import best_match


def words(t):
    return [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in t).split(" ") if w]


def quality(t):
    w = words(t)
    n = len(w)
    wins = [tuple(w[i : i + 5]) for i in range(n - 4)]
    cov = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
    lines = [x for x in t.split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    return not (n < 10 or 100 * len(cov) > 20 * n or 2 * symbols > chars or 10 * dup > 7 * len(lines) or chars > 40 * n)


def shingles(t, k=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return [r for r in rows if comp[r[0]] == r[0]]


def repeats(rows, length=100):
    first, out = set(), []
    for i, t in sorted(rows):
        raw = t.encode()
        gone = set()
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in first:
                gone.update(range(s, s + length))
            first.add(raw[s : s + length])
        out.append((i, bytes(b for p, b in enumerate(raw) if p not in gone).decode(errors="ignore")))
    return out


def clean(rows, items):
    items = [x for x in map(decontam.normalise, items) if x]
    return [r for r in rows if not any(best_match(x, decontam.normalise(r[1]), decontam.budget(x)) for x in items)]


@pytest.fixture
def tables(tmp_path):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghiæé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(20)) for i in range(5)] + [(9, None), (10, "")]
    passage = say(60)
    rows = [(i, say(rnd.randint(0, 80))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(4)]
    rows += [(50 + i, rows[10 + i][1] + " " + rnd.choice(vocab)) for i in range(6)]
    rows += [(60 + i, say(15) + "\n" + passage + "\n" + say(15)) for i in range(4)]
    rows += [(70 + i, say(20) + " " + items[i][1] + " " + say(20)) for i in range(3)]
    rows += [(80, "a b c d e f " * 12), (81, None), (82, ""), (83, "| # | " * 40), (84, "x" * 900)]
    rnd.shuffle(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": None, "source": "s", "n_chars": None if t is None else len(t)} for i, t in rows], schema), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": i, "text": t} for i, t in items], pa.schema([("item_id", pa.int64()), ("text", pa.string())])), tmp_path / "benchmark.parquet")
    return str(tmp_path), rows, [t for _, t in items]


def test_against_brute_force(spark, tables):
    path, rows, items = tables
    rows = [(i, t) for i, t in rows if quality(t or "")]
    rows = clean(repeats(near(rows)), items)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.MULTILINGUAL), special_tokens={})
    want = sorted((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows for e in [enc.encode_ordinary(t)])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want and 30 < len(got) < 60


def test_stages_keep_columns_and_take_nulls(spark, tables):
    path = tables[0]
    schema = spark.read.parquet(f"{path}/documents.parquet").schema
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, None, None, None, None), (None, text, None, None, None), (1, text, None, None, None), (1, text, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == (2 if docs.count() else 0)
