"""How far the sources of a language differ in their words: Gustavson row accumulation over a term-major index.

All sums are of whole numbers. Shares are in parts of 10 ** 9, smoothed by one occurrence of every kept term.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import frugal, string_buffer
from .scratch import sized, written

SCALE = 1_000_000_000
#: Bytes of text whose terms are counted together before they are shuffled.
PIECE = 4 << 20
#: Postings that one task holds (more where a language has so many pairs of groups, which each task sums, up to a bound of
#: memory), groups whose rows it accumulates, and entries that it scatters at once. Only the plan depends on them.
BLOCK, MOST, ROWS, AT_ONCE = 1 << 16, 1 << 22, 1000, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_COUNTS = "lang string, source string, term string, n long, docs long"


# ---- counts ----


def terms(buf: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts between the offsets, A-Z lower-cased, and the number of the text that each is from."""
    low = _LOWER[buf[at[0] : at[-1]]]
    own = _TERM[low]
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = own[1:] != own[:-1]
    edge[at - at[0]] = True
    start, end = np.flatnonzero(edge[:-1] & own), np.flatnonzero(edge[1:] & own) + 1
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[own])))
    return found, np.searchsorted(at - at[0], start, "right") - 1


def _cuts(buf: np.ndarray, a: int, b: int) -> list[int]:
    """Offsets that cut a long text into pieces of PIECE bytes or so, none within a term."""
    out = [a]
    while b - out[-1] > PIECE:
        x = out[-1] + PIECE
        while x < b and _TERM[buf[x - 1]] and _TERM[buf[x]]:
            x += 1
        out.append(x)
    return [*out, b] if out[-1] < b else out


def _slices(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """First text, offsets, and whether these are pieces of that one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if at[j] - at[i] > PIECE:
            yield i, np.array(_cuts(buf, int(at[i]), int(at[j]))), True
        else:
            yield i, at[i : j + 1], False
        i = j


def _of_slice(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; then text, term number and count for each term of a text."""
    found, text = terms(buf, offsets)
    coded = found.dictionary_encode()
    key, n = np.unique(text * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, key // max(1, len(coded.dictionary)), key % max(1, len(coded.dictionary)), n


@frugal
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in a slice's texts of one group, and how many of these texts have it."""
    schema = pa.schema([(n, pa.string()) for n in ("lang", "source", "term")] + [(n, pa.int64()) for n in ("n", "docs")])
    for batch in batches:
        buf, at = string_buffer(batch.column("text"))
        kind = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
        lang, source = (kind.field(c) for c in range(2))
        group = pd.MultiIndex.from_arrays([lang.to_pandas(), source.to_pandas()]).factorize()[0]
        one = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
        one[group] = np.arange(len(group))  # a row of each group
        for i, offsets, pieces in _slices(buf, at):
            if pieces:  # a long text: its pieces' counts are put together
                parts = [_of_slice(buf, offsets[k : k + 2]) for k in range(len(offsets) - 1)]
                t = pa.table({"term": pa.concat_arrays([p[0].take(pa.array(p[2])) for p in parts]), "n": np.concatenate([p[3] for p in parts])})
                t = t.group_by("term").aggregate([("n", "sum")])
                words, n, docs, row = t["term"].combine_chunks(), t["n_sum"].to_numpy(), np.ones(len(t), np.int64), np.full(len(t), i)
            else:
                names, text, code, count = _of_slice(buf, offsets)
                key, inverse = np.unique(group[text + i] * max(1, len(names)) + code, return_inverse=True)
                docs, n = np.bincount(inverse, minlength=len(key)), np.zeros(len(key), np.int64)
                np.add.at(n, inverse, count)
                words, row = names.take(pa.array(key % max(1, len(names)))), one[key // max(1, len(names))]
            if len(words):
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([lang.take(row), source.take(row), words, pa.array(n), pa.array(docs)], schema=schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs for docs (lang, source, text) without nulls. Counts are put together per slice of texts, then map-side, then by a shuffle, so no group or term is hot."""
    return docs.select("lang", "source", "text").mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- shares and divergences ----


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10 ** 9 * (count + 1) / (total + kept)), exact for counts up to 10 ** 18."""
    return F.call_function("div", (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + kept).cast("decimal(20,0)")) + 1


def _distance(p, q):
    return (p - q) * (p - q) // q


def accumulate(term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of `rows` and each group: the sum of floor((p - q) ** 2 / q) over the terms that occur in `term`.

    Postings are (term, group, p); a group without a posting has its `zero` as p. Each row begins with what the sum would be
    if it had no term in common with anybody, by distinct values of p; then it scatters its terms through the term-major index
    into its accumulator, one entry per group, and corrects the shared ones. Sums are modulo 2 ** 64 on the way.
    """
    names, term = np.unique(term, return_inverse=True)
    order = np.lexsort((group, term))
    by_term, by_group, by_p = term[order], group[order], p[order]
    at = np.searchsorted(by_term, np.arange(len(names) + 1))
    mine = np.argsort(group, kind="stable")
    start = np.searchsorted(group[mine], np.arange(len(zero) + 1))
    kinds, several = np.unique(np.stack((group, p), axis=1).reshape(-1, 2), axis=0, return_counts=True)
    kind_at = np.searchsorted(kinds[:, 0], np.arange(len(zero) + 1))
    out = np.empty((len(rows), len(zero)), np.int64)
    for r, g in enumerate(rows.tolist()):
        base = _distance(zero[g], zero)
        acc = base * len(names)
        np.add.at(acc, kinds[:, 0], several * (_distance(zero[g], kinds[:, 1]) - base[kinds[:, 0]]))
        for k in range(kind_at[g], kind_at[g + 1]):
            acc += several[k] * (_distance(kinds[k, 1], zero) - base)
        own = mine[start[g] : start[g + 1]]
        t, pt = term[own], p[own]
        sizes = at[t + 1] - at[t]
        cut = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), AT_ONCE), "right")
        for a, b in pairwise([*np.unique(cut).tolist(), len(t)]):
            n = sizes[a:b]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[t[a:b]], n)
            peer, q, own_p = by_group[inner], by_p[inner], np.repeat(pt[a:b], n)
            z = zero[peer]
            np.add.at(acc, peer, _distance(own_p, q) - _distance(own_p, z) - _distance(zero[g], q) + _distance(zero[g], z))
        out[r] = acc
    return out


_PAIRS = "lang string, source string, item string, value long"


def _pairs(key: tuple, postings: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    groups = groups.sort_values("gid", ignore_index=True)
    gid, names = groups["gid"].to_numpy(np.int64), groups["source"].to_numpy(object)
    rows = np.flatnonzero(groups["shard"].to_numpy() == key[2])
    at = np.searchsorted(gid, postings["gid"].to_numpy(np.int64))
    acc = accumulate(postings["term_id"].to_numpy(np.int64), at, postings["p"].to_numpy(np.int64), groups["zero"].to_numpy(np.int64), rows)
    a, b = np.repeat(rows, len(gid)), np.tile(np.arange(len(gid)), len(rows))
    other = a != b
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "source": names[a[other]], "item": names[b[other]], "value": acc.ravel()[other]})


def _blocks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums by pair of sources. A language's terms are dealt into blocks, the rows of a block into shards; every task gets all of its language's groups, and gives one number for each pair."""
    shards = F.ceil(F.col("n_groups") / ROWS).cast("int")
    block = F.ceil(F.col("postings") / F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.col("n_groups") * F.col("n_groups")))).cast("int")
    groups = groups.withColumn("shards", shards).withColumn("blocks", F.greatest(F.lit(1), block))
    sides = groups.select("lang", "source", "gid", "zero", F.pmod(F.xxhash64("gid"), F.col("shards")).cast("int").alias("shard"), "shards", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sides = sides.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    posted = kept.join(sized(groups.select("gid", "shards", "blocks"), 3), "gid")
    posted = posted.select("lang", "gid", "term_id", "p", F.pmod(F.xxhash64("term_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("task"))
    by = ("lang", "block", "task")
    parts = posted.groupBy(*by).cogroup(sides.groupBy(*by)).applyInPandas(_pairs, _PAIRS)
    return parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out if most is None else out.where(F.col("rank") <= most)  # tasks drop what can't reach that before the shuffle


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms from the language.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased; a language keeps those that min_docs of
    its rows have at least, V of them. With N the occurrences of kept terms, a side (a source of the language, or all of it)
    gives each kept term p = 1 + floor(10 ** 9 * (count + 1) / (N + V)), and two sides differ by f = floor((p - q) ** 2 / q).
    Part `pair`: item is another source of the language, value the sum of f over all kept terms. Part `term`: item is a
    term that the source has and gives more than the language, value its f; the first `top` only.
    Ranks are by value, largest first, then by the item's bytes.

    Null text, lang and source are ''. Each row is a document; repeated rows count again. A source without kept terms has
    pairs but no terms; without kept terms of the language, values are 0. Only the three named columns are read, so others
    can't clash. An empty table gives an empty one.
    """
    d = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = written(term_counts(d), "counts")
    words = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    words = written(words.select("lang", "term", "total").withColumn("term_id", F.monotonically_increasing_id()), "words")
    kept = written(counts.drop("docs").join(words, ["lang", "term"]), "kept")
    groups = d.groupBy("lang", "source").agg(F.lit(1).alias("one")).select("lang", "source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_terms")), ["lang", "source"], "left")
    groups = written(groups.na.fill(0).withColumn("gid", F.monotonically_increasing_id()), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("own_n").alias("lang_n"), F.sum("own_terms").alias("postings"))
    langs = langs.join(words.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0)
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("own_n"), F.col("v"))).otherwise(1)
    groups = written(groups.join(langs, "lang").withColumn("zero", zero), "groups")
    kept = kept.join(sized(groups.select("lang", "source", "gid", "own_n", "lang_n", "v"), 14), ["lang", "source"])
    kept = kept.withColumn("p", share(F.col("n"), F.col("own_n"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v")))
    kept = written(kept.select("lang", "source", "gid", "term", "term_id", "p", "q"), "shares")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    of_terms = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    return _ranked(_blocks(kept, groups), "pair").unionByName(_ranked(of_terms, "term", top))
