"""Removal of repeated byte strings: longest-previous-factor arrays over suffixes that content-defined anchors select.

A byte goes if a string of `length` bytes that covers it also starts earlier, that is, at a smaller (doc_id, start). In
terms of the longest-previous-factor array LPF: all bytes of [i, i + length) with LPF[i] >= length.

1. anchors(): every window of `length` bytes is owned by the 32-gram in it with the least hash, the leftmost of equals. That
   depends on the window's bytes alone, so equal windows anywhere have equal owners at equal offsets. Consecutive windows
   with one owner make one row. Windows whose gram occurs once in the corpus can't be repeated; one shuffle of grams, at most
   one row for each gram and batch, leaves those that may be.
2. Only the bytes around these are fetched, and dealt into buckets by gram. A gram with more surroundings than a bucket takes
   is dealt out by longer common strings: its windows are halved by where the gram lies in them, and each half has more bytes
   in common, up to the whole window.
3. A bucket gets a suffix array (to the depth of `length`), previous and next smaller positions and LPF. Surroundings of equal
   bytes are one entry with a multiplicity: of equal suffixes the first is the earlier match of all others. The same holds of
   equal spans within a batch, which are found by hash, compared byte by byte and set apart in step 1: the first of them stands
   for all in the suffix order, and most copies of whole passages are told so (README has the share).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import Powers, byte_table, frugal, mix, string_buffer
from .scratch import join_ids, set_aside, written

GRAM = 32
#: Bytes of text looked at together; owners are packed with positions of 20 bits.
PIECE = 1 << 19
#: Bytes of text whose rows are compared with each other before they are shuffled.
BATCH = 12 << 20
#: Surroundings of one gram in a bucket (about 50 MB of suffixes) before it's dealt out, and of all a bucket's grams on average.
HOT, BUCKET = 1 << 13, 2000
_U = np.uint64
_LOW = _U((1 << 20) - 1)
_GRAMS, _SPANS = byte_table(5), byte_table(55)
NO_ID = -(1 << 63)
#: q >= 0: a row of windows s to s + len around a gram at s + off, q = c << 20 | len << 10 | off. Of the rows with one gram in
#: a batch one has their number as c, and the gram's hash as h; the others have c = 0, a key of their own as h, and the gram's
#: hash as g. q < 0: windows s to s - q - 1, later copies of ones in the batch.
ANCHORS = "h long, d long, t long, s long, q long, g long"


# ---- suffix order ----


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `starts` in the order of the suffixes' first `depth` bytes (ties by place), and each one's common prefix with the one before. All starts need depth bytes."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, depth)[starts])
    order = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    lcp = np.zeros(len(starts), np.int64)
    for a in range(1, len(order), 1 << 15):  # a part at a time, to hold few copies of the rows
        part = rows[order[a - 1 : a + (1 << 15)]]
        same = part[1:] == part[:-1]
        lcp[a : a + (1 << 15)] = np.where(same.all(axis=1), depth, same.argmin(axis=1))
    return order, lcp


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LPF by place: the longest common prefix with a suffix of smaller rank (ranks are distinct positions in the corpus).

    One pass over the suffix order with a stack: the entry below a suffix is its previous smaller position, the one that
    takes it off the stack its next smaller; common prefixes over longer ways are minima, carried along.
    """
    lpf = np.zeros(len(rank), np.int64)
    stack: list[tuple[int, int, int]] = []  # rank, place, common prefix with the entry below
    for place, r, c in zip(order.tolist(), rank[order].tolist(), lcp.tolist(), strict=True):
        while stack and stack[-1][0] > r:
            _, gone, below = stack.pop()
            lpf[gone] = max(lpf[gone], c)
            c = min(c, below)
        if stack:
            lpf[place] = c
        stack.append((r, place, c))
    return lpf


def repeated_starts(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each start whether LPF >= length. Suffixes that share less with both neighbours in suffix order can't reach it and are left out of the stack pass."""
    order, lcp = suffix_order(text, starts, length)
    long = lcp >= length
    near = long | np.append(long[1:], False)
    out = np.zeros(len(starts), bool)
    kept = order[near]
    # What was left out between two runs has cut their common prefix below length already.
    out[kept] = longest_previous_factor(order[near], np.where(long, lcp, 0)[near], rank)[kept] >= length
    return out


# ---- anchors ----


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while k * 2 <= width:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (width - k)], a[width - k :]) if width > k else a


def windows_by_owner(piece: np.ndarray, valid: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of valid window starts with one owner: first and last start, place of the owner, its hash, hash of all bytes spanned."""
    h, k, m = _GRAMS[piece], 1, 0xD6E8FEB86659FD93
    while k < GRAM:
        h = h[:-k] * _U(m) + h[k:]
        m, k = m * m % 2**64, k * 2
    h = mix(h)
    packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    own = (_sliding_min(packed, length - GRAM + 1) & _LOW).astype(np.int64)
    new = np.ones(len(own) + 1, bool)
    new[1:-1] = (own[1:] != own[:-1]) | ~(valid[1:] & valid[:-1])
    s, e = np.flatnonzero(new[:-1] & valid), np.flatnonzero(new[1:] & valid)
    p = own[s]
    x = powers.between(powers.sums(_SPANS[piece]), s, e + length)
    return s, e, p, h[p], mix(x + mix((e - s).astype(np.uint64) * _U(4096) + (p - s).astype(np.uint64)))


def _pieces(offsets: np.ndarray, length: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of pieces of `size` bytes or so. A long text is cut into overlapping pieces, each window start in one of them."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        for at in range(a, max(a + 1, b - length + 1), size):
            yield i, j, at, min(b, at + size + length - 1)
        i = j


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to BATCH bytes of text, or one text."""
    for batch in batches:
        _, at = string_buffer(batch.column("text"))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and b, sizes of them, are the same."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        n = sizes[k : k + (1 << 15)]
        first = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(first, n)
        same = buf[np.repeat(a[k : k + (1 << 15)], n) + inner] == buf[np.repeat(b[k : k + (1 << 15)], n) + inner]
        out[k : k + (1 << 15)] = np.logical_and.reduceat(same, first)
    return out


def _heads(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the first one, in an order, of those with equal keys, which the order puts together."""
    new = np.append(True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]))
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _anchors(length: int, size: int):
    schema = pa.schema([(n, pa.int64()) for n in ("h", "d", "t", "s", "q", "g")])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(size + length)
        for batch in _slices(batches):
            buf, at = string_buffer(batch.column("text"))
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "t"))
            parts = []
            for i, j, a, b in _pieces(at, length, size):
                if b - a < length:
                    continue
                starts = b - a - length + 1
                edge = np.zeros(starts + 1, np.int64)  # +1 where a text's valid starts begin, -1 where they end
                first, last = np.clip(at[i:j] - a, 0, starts), np.clip(at[i + 1 : j + 1] - length + 1 - a, 0, starts)
                ok = last > first
                np.add.at(edge, first[ok], 1)
                np.add.at(edge, last[ok], -1)
                s, e, p, h, x = windows_by_owner(buf[a:b], np.cumsum(edge[:-1]) > 0, length, powers)
                # of texts that end where others begin, the last one that starts there
                row = np.searchsorted(at[i : j + 1], s + a, "right") - 1 + i
                parts.append((row, s + a, e - s, p - s, h.view(np.int64), x.view(np.int64)))
            if not parts:
                continue
            row, place, n, off, h, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            d, t, s = ids[row], texts[row], place - at[row]
            order = np.lexsort((t, s, d, x, h))
            head = _heads(order, h, x)
            later = np.flatnonzero((d != d[head]) | (s != s[head]) | (t != t[head]))
            later = later[_equal(buf, place[later], place[head[later]], n[later] + length)]
            again = np.zeros(len(row), bool)
            again[later] = True
            # Of what's left, one row for each gram goes to the gram, the others elsewhere: they are known not to be the only ones.
            left = np.flatnonzero(~again)
            order = np.argsort(h[left], kind="stable")
            first = left[_heads(order, h[left])]
            count = np.bincount(first, minlength=len(row))
            own = mix((d * 1_000_003 + s).view(np.uint64) ^ t.view(np.uint64)).view(np.int64)
            meets = count > 0
            rows = [np.where(meets, h, own)[left], d[left], t[left], s[left], (count << 20 | n << 10 | off)[left]]
            if len(left) < len(row):
                k = np.flatnonzero(again)
                k = k[np.lexsort((s[k], row[k]))]
                new = np.append(True, (row[k][1:] != row[k][:-1]) | (s[k][1:] > (s + n)[k][:-1] + 1))
                run_of = np.flatnonzero(new)
                spans = np.maximum.reduceat((s + n)[k], run_of) - s[k[run_of]]
                k = k[run_of]
                rows = [np.concatenate(c) for c in zip(rows, [own[k], d[k], t[k], s[k], -1 - spans], strict=True)]
            hidden = np.append(np.where(meets, 0, h)[left], np.zeros(len(rows[0]) - len(left), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, hidden)], schema=schema)

    return run


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Rows of ANCHORS for docs (d, t, text): d and t tell texts apart, s is a window's start."""
    return docs.select("d", "t", "text").mapInArrow(_anchors(length, PIECE), ANCHORS)


def _with_keys(docs: DataFrame, id_col: str, text: str, tell: bool) -> DataFrame:
    """docs with d (the id) and text without nulls, and t: the text's hash if tell, as is needed where ids are repeated."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    t = F.xxhash64(clean) if tell else F.lit(0).cast("long")
    return docs.withColumn("d", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("t", t).withColumn("text", clean)


# ---- buckets ----

#: Surroundings of one key: windows s to s + len with the gram at s + off, and their bytes. piece: which of 2 ** level equal
#: parts of the gram's places in a window these windows have.
_CONTEXT = "key long, level int, piece int, d long, t long, s long, off long, bytes binary"
#: As many levels leave one place to a part.
LEVELS = 7


_CUT = pa.schema([("key", pa.int64()), ("level", pa.int32()), ("piece", pa.int32()), ("d", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("off", pa.int64()), ("bytes", pa.binary())])


def _cut(length: int):
    """The surroundings that texts are asked for, some thousands at a time."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = string_buffer(batch.column("text"))
            want = batch.column("want")
            ends = np.cumsum(pa.compute.list_value_length(want).to_numpy(zero_copy_only=False))
            s, h, q = (want.flatten().field(c).to_numpy() for c in ("s", "h", "q"))
            row = np.searchsorted(ends, np.arange(len(s)), "right")
            first, last = at[row] + s, at[row] + s + (q >> 10 & 1023) + length
            d, t = (batch.column(c).to_numpy()[row] for c in ("d", "t"))
            zero = np.zeros(len(s), np.int32)
            for k in range(0, len(s), 1 << 14):
                part = slice(k, k + (1 << 14))
                found = pa.array([buf[x:y].tobytes() for x, y in zip(first[part].tolist(), last[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in (h, zero, zero, d, t, s, q & 1023)), found], schema=_CUT)

    return run


def halves(key: int, level: int, piece: int, off: int, raw: bytes, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The surroundings cut by the gram's place in a window: (key, piece, start from the old one, off, bytes) for each half that has windows.

    The key is a hash of all bytes that the windows of that half have in common, whatever lies around them.
    """
    places = length - GRAM + 1
    for half in (2 * piece, 2 * piece + 1):
        least, most = places * half // 2 ** (level + 1), places * (half + 1) // 2 ** (level + 1) - 1
        a, b = max(0, off - most), min(len(raw) - length, off - least)
        if a <= b and least <= most:
            common = raw[off - least : off - most + length]
            name = hashlib.blake2b(common, digest_size=8, key=b"%d.%d.%d" % (key, level, half)).digest()
            yield int.from_bytes(name, "little", signed=True), half, a, off - a, raw[a : b + length]


def _halved(length: int):
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, level, piece, d, t, s, off, raw in f.itertuples(index=False, name=None):
                rows += [(k, level + 1, h, d, t, s + a, o, x) for k, h, a, o, x in halves(key, level, piece, off, raw, length)]
            yield pd.DataFrame(rows, columns=f.columns)

    return run


def _runs(d: np.ndarray, t: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """Consecutive starts as intervals; s grows within each d, t."""
    if not len(s):
        return pd.DataFrame({"d": d, "t": t, "s": s, "e": s})
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))
    return pd.DataFrame({"d": d[new], "t": t[new], "s": s[new], "e": s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]})


def _spread(f: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """All windows of the contexts: text, starts in it, and d, t, s of each."""
    sizes = f["bytes"].map(len).to_numpy()
    n = sizes - length + 1
    row = np.repeat(np.arange(len(f)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[row] + inner
    d, t, s = (f[c].to_numpy()[row] for c in ("d", "t", "s"))
    return np.frombuffer(b"".join(f["bytes"]), np.uint8), at, d, t, s + inner


def _bucket(length: int, size: int):
    def one(f: pd.DataFrame) -> pd.DataFrame:
        text, at, d, t, s = _spread(f, length)
        o = np.lexsort((t, s, d))
        again = np.zeros(len(o), bool)
        again[o] = repeated_starts(text, at[o], np.arange(len(o)), length)
        o = np.lexsort((s, t, d))
        o = o[again[o]]
        return _runs(d[o], t[o], s[o])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Whole keys together, about `size` surroundings at a time; equal windows have equal keys."""
        f = f.drop_duplicates(["key", "d", "t", "s"]).sort_values(["key", "d", "s", "t"], ignore_index=True)
        copy = f.duplicated(["key", "bytes"])
        out = f.loc[copy, ["d", "t", "s"]].assign(e=f["s"] + f["bytes"].map(len) - length)
        f = f[~copy]
        f = f[f.groupby("key")["key"].transform("size") > 1]  # a key with one surrounding is settled
        n = f.groupby("key")["key"].size().cumsum() // size
        return pd.concat([out, *(one(g) for _, g in f.groupby(f["key"].map(n)))])

    return run


def _buckets(contexts: DataFrame, rows: int, length: int) -> DataFrame:
    key = F.pmod("key", F.lit(max(1, -(-rows // BUCKET)))).alias("bucket")
    return contexts.groupBy(key).applyInPandas(_bucket(length, BUCKET), "d long, t long, s long, e long")


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """d, t, s, e: intervals of window starts (s to e) for which an equal window starts earlier in docs (d, t, text)."""
    if not GRAM <= length < 1024 - GRAM:
        raise ValueError("length must be at least that of a gram and below 992")
    a = anchors(docs, length).repartition("h")
    n = F.sum(F.greatest(F.shiftright("q", 20), F.lit(0))).over(Window.partitionBy("h"))
    told = a.withColumn("n", n).where("q < 1048576 or n > 1")
    told = written(told.select("d", "t", "s", "q", F.when(F.col("q") < 1 << 20, F.col("g")).otherwise(F.col("h")).alias("h")), "repeats")
    border = told.where("q >= 0").groupBy("d", "t").agg(F.collect_list(F.struct("s", "h", "q")).alias("want"))
    ids = written(told.where("q >= 0").select("d", "t").distinct(), "ids")
    own = join_ids(docs.select("d", "t", "text"), ids, ["d", "t"], "left_semi")
    contexts = written(own.join(border, ["d", "t"]).mapInArrow(_cut(length), _CONTEXT), "contexts")
    out = told.where("q < 0").select("d", "t", "s", (F.col("s") - F.col("q") - 1).alias("e"))
    for _ in range(LEVELS):
        sizes = contexts.groupBy("key").agg(F.count("*").alias("n"))
        hot = written(sizes.where(F.col("n") > HOT).select("key"), "hot")
        if hot.isEmpty():
            break
        cold = join_ids(contexts, hot, ["key"], "left_anti").select(*contexts.columns)
        out = out.unionByName(_buckets(cold, contexts.count(), length))
        contexts = written(join_ids(contexts, hot, ["key"], "left_semi").select(*contexts.columns).mapInPandas(_halved(length), _CONTEXT), "contexts")
    return out.unionByName(_buckets(contexts, contexts.count(), length))


def _strip(length: int, names: list[str]):
    """Rows without `text` and `gone`, but with what is left of the text; some megabytes at a time."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = string_buffer(batch.column("text"))
            gone, rest = batch.column("gone"), batch.select([n for n in batch.schema.names if n not in ("text", "gone")])
            a, size, out = 0, 0, []
            for i in range(len(batch)):
                raw = buf[at[i] : at[i + 1]].tobytes()
                spans: list[list[int]] = []
                for w in sorted((g["s"], g["e"] + length) for g in gone[i].as_py() or ()):
                    if spans and w[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], w[1])
                    else:
                        spans.append(list(w))
                kept = b"".join(raw[x:y] for x, y in zip([0, *(z for _, z in spans)], [*(x for x, _ in spans), len(raw)], strict=True)) if spans else raw
                out.append((len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
                size += len(raw)
                if size >= 1 << 22 or i + 1 == len(batch):
                    made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*rest.slice(a, i + 1 - a).columns, *made], names=names)
                    a, size, out = i + 1, 0, []

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = True) -> DataFrame:
    """All rows of docs plus n_bytes, n_removed, n_spans (long), kept_sha256 and, if with_text, kept (binary: what is left; removed runs needn't end at character borders).

    Null texts count as empty. Rows that repeat another's id and text are one document, so neither removes from the other;
    texts that share an id are ordered by start, then by the text's hash; a null id comes before all others. Texts shorter
    than `length` bytes lose nothing. Columns named like the added ones are replaced, no others clash.
    """
    docs, (id_col, text), back = set_aside(docs, {"d", "t", "gone", *({"text"} if text != "text" else ())}, id_col, text)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    keep = [c for c in docs.columns if c not in {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", text}]
    ids = docs.select(F.col(id_col).cast("long").alias("d"))
    tell = not ids.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    gone = repeats(_with_keys(docs.select(id_col, text), id_col, text, tell), length)
    gone = written(gone.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("gone")), "gone")
    rows = _with_keys(docs.select(*keep, text), id_col, text, tell).select(*keep, "d", "t", "text")
    # Texts that lose something meet what they lose; the others stay where they are, unless there are too many to tell so.
    ids = gone.select("d", "t")
    less = join_ids(rows, ids, ["d", "t"], "left_semi").join(gone, ["d", "t"])
    rest = join_ids(rows, ids, ["d", "t"], "left_anti").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    rows = less.select(*keep, "text", "gone").unionByName(rest.select(*keep, "text", "gone"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.select(*keep).dtypes)
    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    out = rows.mapInArrow(_strip(length, names), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(*keep, *added).transform(back)
