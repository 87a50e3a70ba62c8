"""Token counts by a compiled finite-state transducer of a BPE vocabulary.

The encoding of a text by BPE is the one sequence of pieces whose neighbours are each other's encoding: pieces a, b may stand
side by side if encoding a + b gives a, b again. So the last piece of every prefix follows from the last pieces at the few
earlier positions where a piece could still begin. That is a finite state: the longest suffix that may grow into a piece, and
for each position in it the last piece and the number of pieces since. Transitions read one character and emit the change of
the token count. States and transitions are compiled as texts reach them; a worker starts anew when it has many. Where two
characters are neighbours in no piece, what came before is forgotten: the transition is that of the first state.

Whether a, b may stand side by side is told by the merges that make them: taken in turn, best first, as they would happen in
a + b, none across the border may come before one of them.

Long texts are cut into chunks. A chunk's state map says for each state at its entry the state at its exit and the count in
between. Its entries are the states that the LEAD characters before it reach from SHIFTS different places: states that differ
soon fall together, and a run of one character is in one of a few phases. Maps compose, so that chunks are counted in parallel
and their maps combined block by block, then blocks by text. Should a text enter a chunk in a state that its map lacks, that
state is added and the text composed again; the counts are exact in any case. Units that lie within a chunk are counted as
those of short texts are.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .buffers import frugal
from .scratch import set_aside, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Longer texts (in characters) are cut into chunks of so many.
CHUNK = 1 << 15
#: Counts of words that a worker keeps before it starts anew, and the characters of the longest one it keeps.
KEPT, LONGEST = 300_000, 64
#: Characters before a chunk that its entry states are found by, and the places they are started from.
LEAD, SHIFTS = 96, 16
#: Chunk maps that are composed together; two levels of them hold any string.
FAN = 256
#: States that a worker keeps before it compiles anew.
STATES = 150_000
#: By entry state: the exit state and the count, or the chunk whose map lacks a state, and that state.
Map = dict[str, tuple[str, int] | tuple[int, str]]


def _merges(text: str, scores: dict[str, float]) -> list[tuple[float, str, str]]:
    """BPE by definition: the adjacent pair with the best score is merged first, the leftmost of equals.

    Of each merge the score, and the first and the last part before it; of the end -inf and those parts.
    """
    parts, out = list(text), []
    while True:
        best = max(((s, -i) for i in range(len(parts) - 1) if (s := scores.get(parts[i] + parts[i + 1])) is not None), default=None)
        out.append((-math.inf if best is None else best[0], parts[0], parts[-1]))
        if best is None:
            return out
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Transducer:
    """Counts the pieces of units, which start at a space after another character and end before the next such place."""

    def __init__(self, model: str = MODEL):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("pieces across a space aren't supported")
        self.prefixes = {p[:i] for p in self.scores for i in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self._made: dict[str, list[tuple[float, str, str]]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states and transitions."""
        self._fits: dict[tuple[str | None, str], bool] = {}
        # Of a state: the suffix, and by position in it the last piece and the count relative to now.
        self._info: list[tuple[str, tuple, tuple]] = []
        self._number: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state("", (None,), (0,))

    def _state(self, suffix: str, last: tuple, counts: tuple) -> int:
        key = (suffix, last, counts)
        if key not in self._number:
            self._number[key] = len(self._info)
            self._info.append(key)
            self.moves.append({})
        return self._number[key]

    def _merges_of(self, piece: str) -> list[tuple[float, str, str]]:
        if piece not in self._made:
            self._made[piece] = _merges(piece, self.scores)
        return self._made[piece]

    def _fit(self, a: str | None, b: str) -> bool:
        right = self._merges_of(b)
        if right[-1][1] != b:  # not its own encoding
            return False
        if a is None:
            return True
        left, i, j = self._merges_of(a), 0, 0
        while True:
            x, _, end = left[i]
            y, begin, _ = right[j]
            across = self.scores.get(end + begin)
            if across is not None and across > x and across >= y:  # of equals the leftmost is first
                return False
            if x >= y:
                if x == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _may_follow(self, a: str | None, b: str) -> bool:
        key = (a, b)
        fits = self._fits.get(key)
        if fits is None:
            fits = self._fits[key] = self._fit(a, b)
        return fits

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state on a character: next state and change of the count."""
        suffix, last, counts = self._info[state]
        if char not in self.scores:  # byte fallback; nothing merges with it
            move = self.start, len(char.encode())
        elif last[-1] is not None and last[-1][-1] + char not in self.pairs:  # no piece crosses this place
            move = self.moves[self.start].get(char) or self.compile(self.start, char)
        else:
            s = suffix + char
            j, piece = next((j, s[j:]) for j in range(len(s)) if s[j:] in self.scores and self._may_follow(last[j], s[j:]))
            n = counts[j] + 1
            at = next((k for k in range(len(s)) if s[k:] in self.prefixes), len(s))
            move = self._state(s[at:], (*last, piece)[at:], tuple(c - n for c in (*counts, n)[at:])), n
        self.moves[state][char] = move
        return move

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after a text and its count."""
        n, moves = 0, self.moves
        for char in text:
            move = moves[state].get(char) or self.compile(state, char)
            state = move[0]
            n += move[1]
        return state, n

    def count(self, unit: str) -> int:
        return self.run(self.start, unit)[1]

    def name(self, state: int) -> str:
        """A state by what it says, the same in every worker."""
        return json.dumps(self._info[state])

    def named(self, name: str) -> int:
        suffix, last, counts = json.loads(name)
        return self._state(suffix, tuple(last), tuple(counts))


class UnitCounts(dict):
    """Counts by unit, computed when first asked for."""

    def __init__(self, model: str):
        self.transducer = Transducer(model)

    def __missing__(self, unit: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        if len(self.transducer.moves) > STATES:
            self.transducer.reset()
        n = self.transducer.count(SPACE + unit)
        if len(unit) <= LONGEST:
            self[unit] = n
        return n


_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BEGIN = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def units(text: str) -> list[str]:
    """Units of a text that starts a word, each without its first space mark."""
    return [u[1:] for u in _UNITS.findall(SPACE + text)]


@lru_cache(2)
def unit_counts(model: str) -> UnitCounts:
    return UnitCounts(model)


def count_tokens(text: str, counts: UnitCounts) -> int:
    if not text:
        return 0
    if SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
        return sum(map(counts.__getitem__, text.split(" ")))
    return sum(map(counts.__getitem__, units(text.replace(" ", SPACE))))


def chunk_map(lead: str, text: str, transducer: Transducer, entries: tuple[str, ...] = (), counts: UnitCounts | None = None) -> Map:
    """The state map of marked text behind `lead`, its last LEAD characters or all that come before; none before the first chunk.

    Entry states are followed to the first unit that begins in the text. It and all behind it but the last are taken from `counts`.
    """
    if len(transducer.moves) > STATES:
        transducer.reset()
    states = {transducer.named(e) for e in entries} or {transducer.run(transducer.start, lead[k:])[0] for k in range(max(1, min(SHIFTS, len(lead))))}
    now = {s: (s, 0) for s in states}
    begin = _BEGIN.search(text)
    at, end = 0, begin.start() if begin else len(text)
    while at < end:
        # States that have fallen together go on as one.
        ends = {s for s, _ in now.values()}
        step = end - at if len(ends) == 1 else min(64, end - at)
        moved = {s: transducer.run(s, text[at : at + step]) for s in ends}
        now = {e: (moved[s][0], n + moved[s][1]) for e, (s, n) in now.items()}
        at += step
    out = {transducer.name(e): (transducer.name(s), n) for e, (s, n) in now.items()}
    if begin is None:
        return out
    last = len(text[: text.rindex(SPACE)].rstrip(SPACE))
    within = transducer.run(transducer.start, text[end:last])[1] if counts is None else sum(counts[u[1:]] for u in _UNITS.findall(text, end, last))
    state, n = transducer.run(transducer.start, text[last:])  # after `counts`, which may begin anew
    return {e: (transducer.name(state), m + within + n) for e, (_, m) in out.items()}


def follow(maps: list[tuple[int, Map]], entry: str) -> tuple[str, int] | tuple[int, str]:
    """Exit state and count of consecutive maps, by chunk number; or the first chunk whose map lacks the state it's entered in, and that state."""
    n = 0
    for no, m in maps:
        found = m.get(entry)
        if found is None:
            return no, entry
        if isinstance(found[0], int):
            return found
        entry, n = found[0], n + found[1]
    return entry, n


def compose(maps: list[tuple[int, Map]]) -> Map:
    """One map of consecutive ones."""
    return {e: follow(maps, e) for e in maps[0][1]}


def _short(model: str):
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = unit_counts(model)
        for f in frames:
            f["n_tokens"] = [count_tokens(t, counts) for t in f.pop("_text")]
            yield f

    return run


def _cut(chunk: int):
    """The chunks of marked texts, each with its lead."""

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b, text in zip(f["a"], f["b"], f["_text"], strict=True):
                marked = SPACE + text.replace(" ", SPACE)
                for some in range(0, len(marked), 64 * chunk):
                    at = range(some, min(len(marked), some + 64 * chunk), chunk)
                    yield pd.DataFrame({"a": a, "b": b, "no": [i // chunk for i in at], "lead": [marked[max(0, i - LEAD) : i] for i in at], "chunk": [marked[i : i + chunk] for i in at]})

    return run


def _chunks(model: str):
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = unit_counts(model)
        for f in frames:
            entry = f["entry"] if "entry" in f else [None] * len(f)
            f["map"] = [json.dumps(chunk_map(x, c, counts.transducer, (e,) if e else (), counts)) for x, c, e in zip(f["lead"], f["chunk"], entry, strict=True)]
            yield f[["a", "b", "no", "map"]]

    return run


def _loaded(f: pd.DataFrame) -> list[tuple[int, Map]]:
    """The maps of a group in order; those of one chunk as one."""
    out: dict[int, Map] = {}
    for no, m in zip(f["no"].tolist(), f["map"], strict=True):
        out.setdefault(no, {}).update({e: tuple(v) for e, v in json.loads(m).items()})
    return sorted(out.items())


def _block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    maps = _loaded(f)
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "no": [maps[0][0]], "map": [json.dumps(compose(maps))]})


def _whole(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    maps = _loaded(f)
    x, y = follow(maps, next(iter(maps[0][1])))
    missed = isinstance(x, int)
    out = pd.DataFrame({"a": [key[0]], "b": [key[1]], "n_tokens": [None if missed else y], "no": [x if missed else None], "entry": [y if missed else None]})
    return out.astype({"n_tokens": "Int64", "no": "Int64"})


def _long_counts(texts: DataFrame, model: str, chunk: int) -> DataFrame:
    """a, b, n_tokens for texts (a, b, _text)."""
    parts = texts.mapInPandas(_cut(chunk), "a long, b long, no long, lead string, chunk string").dropDuplicates(["a", "b", "no"])
    kind = "a long, b long, no long, map string"
    maps = written(parts.mapInPandas(_chunks(model), kind), "maps")
    while True:
        blocks = maps.groupBy("a", "b", F.floor(F.col("no") / FAN)).applyInPandas(lambda key, f: _block(key, f), kind)
        counted = written(blocks.groupBy("a", "b").applyInPandas(_whole, "a long, b long, n_tokens long, no long, entry string"), "counted")
        missed = counted.where("n_tokens is null")
        if missed.isEmpty():
            return counted.select("a", "b", "n_tokens")
        more = parts.join(missed.select("a", "b", "no", "entry"), ["a", "b", "no"])
        maps = written(maps.unionByName(more.mapInPandas(_chunks(model), kind)), "maps")


def token_counts(docs: DataFrame, model: str = MODEL, text: str = "text", limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns of docs plus n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > limit).

    A null text counts as empty: zero tokens. Texts of up to `chunk` characters are counted where they lie, without a
    shuffle. Longer ones are counted once for each distinct text: their chunks are dealt out over the cluster, their state
    maps composed. Columns named like the added ones are replaced, no others clash.
    """
    docs, (text,), back = set_aside(docs, {"_text", "_a", "_b", "a", "b"}, text)
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    d = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    d = d.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    long = F.length("_text") > chunk
    kinds = ", ".join(f"`{n}` {k}" for n, k in d.drop("_text").dtypes)
    short = d.where(~long).mapInPandas(_short(model), f"{kinds}, n_tokens long")
    marked = d.where(long).withColumn("_a", F.xxhash64("_text")).withColumn("_b", F.xxhash64(F.reverse("_text"), F.col("_text")))
    counted = _long_counts(marked.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "_text"), model, chunk)
    light = marked.drop("_text")
    whole = light.join(counted, (light["_a"] == counted["a"]) & (light["_b"] == counted["b"])).select(*keep, "n_bytes", "n_tokens")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit).transform(back)
