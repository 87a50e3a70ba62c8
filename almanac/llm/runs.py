"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended into runs.

By the runs theorem (Bannai et al., 2017) every maximal repetition with period p has, under an order of the alphabet or under
its inverse, Lyndon roots: words of p symbols that are the longest Lyndon words at their starts. Baier's first phase (2016)
puts suffixes into groups by just that word, so equal roots that follow each other are members of one group, p apart.

Each text is looked at in its own row: no shuffle, and nothing grows with a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .buffers import frugal, mix, string_buffer

ADDED = ("runs", "collapsed")
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_U = np.uint64
#: Bytes of text whose results are handed on together.
PART = 4 << 20


def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that starts there, and a number that places with equal such words share.

    Ranks are 0 to k - 1. Groups, at first of equal symbols, are taken from the highest down. A group's suffixes start with one
    word u. Each looks for the nearest place before it that is in a lower group; what starts there goes on with as many u as
    look to it, and moves to a new group just above its old one, above those that got fewer.
    """
    n, k = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, length = list(ranks), [1] * k
    below, above = list(range(-1, k - 1)), [*range(1, k), -1]
    prev, seen = [-1] * n, bytearray(n + 1)  # seen: in this group or a higher one; the last byte stands for "no place"
    word = [0] * n
    g = k - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        size = length[g]
        for i in own:
            seen[i] = 1
            word[i] = size
        met, last, c = [], -1, 0
        for i in own:
            p = i - 1
            while seen[p]:
                p = prev[p]
            prev[i] = p
            if p == last:
                c += 1
            else:
                if last >= 0:
                    met.append((c, last))
                last, c = p, 1
        if last >= 0:
            met.append((c, last))
        met.sort(key=lambda x: -x[0])  # stable: places stay in order
        new: dict[tuple[int, int], int] = {}
        for c, p in met:
            h = group[p]
            x = new.get((c, h))
            if x is None:
                x = new[c, h] = len(members)
                members.append([])
                length.append(length[h] + c * size)
                up = above[h]
                below.append(h)
                above.append(up)
                below[up] = above[h] = x
            members[x].append(p)
            group[p] = x
        g = below[g]
    return word, group


def _roots(word: list[int], group: list[int], times: int) -> Iterator[tuple[int, int]]:
    """Start and period of each first root of `times` or more that follow each other."""
    p, g = np.array(word, np.int64), np.array(group, np.int64)
    i = np.arange(len(p))
    ok = np.ones(len(p), bool)
    for _ in range(times - 1):
        i = i + p
        ok &= i < len(p)
        ok[ok] = g[i[ok]] == g[ok]
    before = np.arange(len(p)) - p
    ok[ok] = (before[ok] < 0) | (g[before[ok]] != g[ok])
    at = np.flatnonzero(ok)
    return zip(at.tolist(), p[at].tolist(), strict=True)


def runs_in(symbols: list[int], least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with length >= max(least, times * period). Symbols are 0 to k - 1."""
    n, top, found = len(symbols), max(symbols, default=0), set()
    for ranks in (symbols, [top - s for s in symbols]):
        for i, p in _roots(*lyndon_groups(ranks), max(1, times - 1)):
            # longest common extensions of the places i and i + p, to both sides
            a, b = i, i + p
            while a and symbols[a - 1] == symbols[a - 1 + p]:
                a -= 1
            while b < n and symbols[b] == symbols[b - p]:
                b += 1
            if b - a >= max(least, times * p):
                found.add((a, b - a, p))
    return found


def window_size(least: int, times: int) -> int:
    """The longest windows of which each one in a run must occur again in it, p before or behind: 2 * p + size - 1 <= length."""
    return max(1, min(max(least, times * p) - 2 * p + 1 for p in range(1, least + 1)))


def stretches(words: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Longest stretches (start, end) of words, by 64-bit hashes, in which each window of `size` words occurs elsewhere in the text.

    No run leaves such a stretch, so that most of a text need not be sorted. Hashes that collide only make stretches longer.
    """
    n = len(words) - size + 1
    if len(words) < least or n < 1:
        return []
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x = x * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    x = mix(x)
    s = np.sort(x)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return []
    again = np.zeros(n + 2, np.int8)
    again[1:-1] = twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x
    edge = np.diff(again)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + size - 1
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def word_runs(words: list[bytes], least: int, times: int, size: int) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found: set[tuple[int, int, int]] = set()
    for a, b in stretches(hashes, size, least):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number)) for w in words[a:b]]
        found.update((a + s, n, p) for s, n, p in runs_in(symbols, least, times))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that some run contains after its first period."""
    out, done = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if a > done:
            out += words[done:a]
        done = max(done, b)
    return out + words[done:]


def _runs(text: str, least: int, times: int, names: list[str]):
    size = window_size(least, times)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            buf, at = string_buffer(row.field(text))
            missing = row.field(text).is_null().to_pylist()
            first, held = 0, 0
            runs: list[list[tuple[int, int, int]]] = []
            texts: list[bytes] = []
            for i in range(len(batch)):
                raw = b"" if missing[i] else buf[at[i] : at[i + 1]].tobytes()
                words = raw.split()  # at 0x20 and 0x09-0x0D
                runs.append(word_runs(words, least, times, size))
                texts.append(b" ".join(collapse(words, runs[-1]) if runs[-1] else words))
                held += len(raw)
                if held >= PART or i + 1 == len(batch):
                    flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                    each = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"])
                    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, runs)]).astype(np.int32), each)
                    yield pa.RecordBatch.from_arrays([row.slice(first, i + 1 - first), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=names)
                    first, held, runs, texts = i + 1, 0, [], []

    return run


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """All rows of docs plus runs (array of start, length, period; by start, then period) and collapsed (string).

    Words are runs of characters other than 0x20 and 0x09-0x0D, numbered from 0. A run is a stretch of words with smallest
    period p and length >= max(min_length, min_exponent * p) that no neighbouring word extends. collapsed is the text's words,
    joined by one space, without those that some run contains after its first p words.

    Null, empty and blank texts have no runs and an empty collapsed text. Each row is judged by itself, so that repeated rows
    get equal results. Columns of docs named runs or collapsed are replaced; no other name clashes, for the row travels in a
    struct. Work and memory go with the length of one text. An empty table gives an empty one.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have an exponent of 2 at least")
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.selectExpr(f"struct({', '.join(f'`{c}`' for c in own)}) AS row")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_runs(text, min_length, min_exponent, ["row", *ADDED]), schema).select("row.*", *ADDED)
