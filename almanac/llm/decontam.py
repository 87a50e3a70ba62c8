"""Benchmark decontamination: test items found in texts within an edit budget, by pigeonhole pieces and Myers' algorithm.

An item of m characters may differ by k = m * percent // 100 edits. Of k + 1 pieces of it at least one is untouched then, so
texts are searched for exact pieces, and only the surroundings of hits are compared, by Myers' bit-parallel distance. An item
with a budget of 0 (under 20 characters at 5 per cent) is one piece: it is found where it occurs as it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import frugal
from .scratch import set_aside, written

#: Edits allowed per hundred characters of an item.
PERCENT = 5
#: Characters of items that are searched for together; more are searched in further blocks, each over all texts.
BLOCK = 4 << 20
#: Characters of a text that are searched for pieces at a time.
SEGMENT = 1 << 20
_RUN = re.compile(r"[^\S ]\s*| \s+")


def normalise(text: str | None) -> str:
    """Lower case; runs of white space become one space; none at the ends."""
    return _RUN.sub(" ", (text or "").lower()).strip()


def budget(item: str, percent: int = PERCENT) -> int:
    return len(item) * percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length that make up the item, with their places."""
    at = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of text, if at most k, and the first end of such a substring."""
    m = len(pattern)
    if masks is None:
        masks = peq(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (k + 1, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= k else None


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Searcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: tuple[tuple[int, str], ...], percent: int):
        # Items of equal text are searched once.
        self.ids: dict[str, list[int]] = defaultdict(list)
        for i, text in items:
            self.ids[text].append(i)
        self.items = [(text, budget(text, percent), peq(text)) for text in self.ids]
        by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (text, k, _) in enumerate(self.items):
            for at, piece in pieces(text, k):
                by_piece[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.longest = max(map(len, by_piece))

    def __call__(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, distance, end in the text) of the best (first of equals) match of each item found.

        Hits are gathered for one segment of the text at a time; a match is compared around each of its pieces, wherever
        segments end.
        """
        best: dict[int, tuple[int, int]] = {}
        for at in range(0, len(text), SEGMENT):
            self._search(text, at, min(len(text), at + SEGMENT), best)
        for n, found in best.items():
            for i in self.ids[self.items[n][0]]:
                yield i, *found

    def _search(self, text: str, a: int, b: int, best: dict[int, tuple[int, int]]) -> None:
        """Better matches than best by pieces that end in text[a:b]."""
        first = max(0, a - self.longest + 1)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text[first:b] if first or b < len(text) else text):
            end += first + 1
            if end <= a:
                continue
            for n, at in places:
                if n not in best or best[n][0]:
                    if self.items[n][1]:
                        starts[n].add(end - size - at)
                    else:
                        best[n] = (0, end)
        for n, at in starts.items():
            item, k, masks = self.items[n]
            for x, y in self._windows(sorted(at), len(item), k):
                found = myers(item, text[max(0, x) : y], best[n][0] - 1 if n in best else k, masks)
                if found:
                    best[n] = (found[0], max(0, x) + found[1])
                    if not found[0]:
                        break

    @staticmethod
    def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        """Where an item could lie that starts within k of one of these places; what overlaps is one window."""
        a, b = starts[0] - k, starts[0] + m + k
        for s in starts[1:]:
            if s - k <= b:
                b = s + m + k
            else:
                yield a, b
                a, b = s - k, s + m + k
        yield a, b


@lru_cache(2)
def _searcher(items: tuple[tuple[int, str], ...], percent: int) -> Searcher:
    return Searcher(items, percent)


def _find(items: tuple[tuple[int, str], ...], percent: int, prepare: Callable[[str], str] = str):
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _searcher(items, percent)
        for f in frames:
            rows = [(i, *found) for i, t in zip(f["doc_id"].tolist(), f["text"], strict=True) for found in search(prepare(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "ends_at"]).astype({"doc_id": "Int64"})

    return run


def _normalised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["text"] = [normalise(t) for t in f["text"]]
        yield f


def _blocks(items: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of BLOCK characters or so; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        text = normalise(r["text"])
        if not text:
            continue
        block.append((r["item_id"], text))
        size += len(text)
        if size >= BLOCK:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, ends_at: one row for each row of docs and item (item_id, text) that it holds within the edit budget.

    Both are lower-cased and runs of white space count as one space; ends_at is where the best (first of equals) match ends in
    the normalised text. Null and blank texts and items match nothing. Repeated rows give repeated results; a document with a
    null id gives a null doc_id. Texts aren't shuffled: the items are a query set, of which blocks of bounded size go to all
    tasks. Texts are normalised once: if there are more blocks than one, they are stored so.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = "doc_id long, item_id long, distance int, ends_at int"
    blocks = _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct())
    block = next(blocks, None)
    if block is None:
        return docs.sparkSession.createDataFrame([], kind)
    more = next(blocks, None)
    if more is None:
        return d.mapInPandas(_find(block, percent, normalise), kind)
    d = written(d.mapInPandas(_normalised, "doc_id long, text string"), "normalised")
    out = d.mapInPandas(_find(block, percent), kind)
    for block in chain([more], blocks):
        out = out.unionByName(d.mapInPandas(_find(block, percent), kind))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with their columns, whatever these are named; rows with a null id stay."""
    docs, (id_col, text), back = set_aside(docs, {"_bad"}, id_col, text)
    bad = leaks(docs.where(F.col(id_col).isNotNull()), items, percent, id_col, text).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("_bad"), "left_anti").transform(back)
