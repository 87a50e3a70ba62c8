"""Near-duplicate groups: min-max hashing, banding, and links confirmed on full shingle sets.

Under each of PERMUTATIONS hash functions a set keeps its least and its greatest value, so that 64 evaluations give 128
signature values. Bands of four values collide with probability J ** 4; of 32 bands at least one does with probability over
1 - 5e-8 at J = 0.8. Sets, not documents, are compared: equal sets are one class from the start, so a text that a third of
all rows share costs one comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import MULTIPLIER, Powers, byte_table, frugal, mix, string_buffer
from .components import components
from .scratch import discard, join_ids, written

PERMUTATIONS, BAND = 64, 4
#: Bytes of text that are hashed together.
PIECE = 1 << 19
#: Members that one star takes before its group is dealt into parts, and sets of one token that one task compares with others.
STAR, SPLIT = 1024, 2048
#: Partners of a set in the first round of the search behind stars, and how many times more in each further one.
FEW, GROWTH = 16, 4
#: Bands whose stars are confirmed before those of the others.
FIRST = 4
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = byte_table(11)
_RANDOM = np.random.default_rng(1)
_TIMES = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_PLUS = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def _word_sums(buf: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Byte sums of all words of the texts between the offsets, their starts and ends, and the offsets of each text's words."""
    buf = _LOWER[buf[at[0] : at[-1]]]
    space = _SPACE[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = space[1:] | space[:-1]
    edge[at - at[0]] = True
    start = np.flatnonzero(edge[:-1] & ~space)
    end = np.flatnonzero(edge[1:] & ~space) + 1
    return powers.between(powers.sums(_BYTES[buf]), start, end), start, end, np.searchsorted(start, at - at[0])


def word_hashes(buf: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts between the offsets, and the offsets of each text's words."""
    sums, start, end, word_at = _word_sums(buf, at, powers)
    return mix(sums + (end - start).astype(np.uint64)), word_at


def _times(k: int) -> list[np.uint64]:
    return [_U(pow(0xD6E8FEB86659FD93, j + 1, 2**64)) for j in range(k)]


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    n = max(0, len(words) - k + 1)
    return mix(sum((words[j : j + n] * t for j, t in enumerate(_times(k))), np.zeros(n, np.uint64)))


def _few(words: np.ndarray, k: int) -> np.ndarray:
    """The one hash of fewer than k words; none of no word."""
    return mix(np.array([sum(int(w) * int(t) for w, t in zip(words, _times(k), strict=False)) % 2**64], np.uint64)) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of fewer words, of the whole sequence; of none, none."""
    full = _windows(words, k)
    return [np.unique(full[a : b - k + 1]) if b - a >= k else _few(words[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def long_set(buf: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """shingle_sets() of one text of any length, PIECE bytes at a time. A word that a piece cuts goes on with its sum so far."""
    found, new, size = np.zeros(0, np.uint64), [], 0
    last = np.zeros(0, np.uint64)  # the last k - 1 words
    total, length = 0, 0  # sum and length of the word that the last piece cut
    for a in range(0, len(buf), PIECE):
        part = buf[a : a + PIECE]
        sums, start, end, _ = _word_sums(part, np.array([0, len(part)]), powers)
        lengths = (end - start).astype(np.uint64)
        if length and (not len(start) or start[0]):  # the cut word ended at the cut
            sums, lengths, start, end = np.append(_U(total), sums), np.append(_U(length), lengths), np.append(-1, start), np.append(0, end)
        elif length:
            sums[0] = (total + pow(MULTIPLIER, length, 2**64) * int(sums[0])) % 2**64
            lengths[0] += _U(length)
        total = length = 0
        if len(end) and end[-1] == len(part) and a + PIECE < len(buf):
            total, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        words = np.concatenate((last, mix(sums + lengths)))
        last = words[max(0, len(words) - k + 1) :]
        new.append(np.unique(_windows(words, k)))
        size += len(new[-1])
        if size > max(len(found), PIECE):
            found, new, size = np.unique(np.concatenate((found, *new))), [], 0
    found = np.unique(np.concatenate((found, *new)))
    return found if len(found) else _few(last, k)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least and greatest value of each non-empty set under each permutation, side by side."""
    if len(sets) == 1 and len(sets[0]) > PIECE:
        parts = np.concatenate([signatures([sets[0][i : i + PIECE]]) for i in range(0, len(sets[0]), PIECE)])
        return np.where(np.arange(2 * PERMUTATIONS) % 2, parts.max(axis=0), parts.min(axis=0))[None]
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        v = flat * _TIMES[p] + _PLUS[p]
        v ^= v >> _U(32)
        np.minimum.reduceat(v, at, out=out[:, 2 * p])
        np.maximum.reduceat(v, at, out=out[:, 2 * p + 1])
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """A hash of every BAND values and their place."""
    parts = sign.reshape(len(sign), -1, BAND)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + _U(1), parts.shape[:2])
    for j in range(BAND):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def _sets_of(batch: pa.RecordBatch, k: int, powers: Powers) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    buf, at = string_buffer(batch.column("text"))
    for i, j in _slices(at):
        if at[j] - at[i] > PIECE:  # one long text
            yield i, j, [long_set(buf[at[i] : at[j]], k, powers)]
        else:
            words, word_at = word_hashes(buf, at[i : j + 1], powers)
            yield i, j, shingle_sets(words, word_at, k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(at, np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets, as two numbers; zeros for empty ones."""
    return np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() if len(s) else bytes(16) for s in sets), np.int64).reshape(-1, 2)


def _signed(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE)
        for batch in batches:
            for i, j, sets in _sets_of(batch, k, powers):
                n, digest = np.array([len(s) for s in sets], np.int64), _digests(sets)
                b: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sets)
                if n.any():
                    for place, row in zip(np.flatnonzero(n).tolist(), bands(signatures([s for s in sets if len(s)])), strict=True):
                        b[place] = row
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(b)], names=["doc_id", "n", "c1", "c2", "bands"])

    return run


def _plain_sets(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE)
        for batch in batches:
            for _, _, sets in _sets_of(batch, k, powers):
                digest = _digests(sets)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(sets)], names=["c1", "c2", "shingles"])

    return run


def signed_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), c1, c2 (digest of the set), bands."""
    return docs.select("doc_id", "text").mapInArrow(_signed(k), "doc_id long, n long, c1 long, c2 long, bands array<long>")


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, node, size, ...) of groups of two and more, with the group's number n and its top, the node and size of the least node."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("top")).where("n > 1")
    return rows.join(groups, key)


def stars(members: DataFrame, key: str) -> DataFrame:
    """a (centre), b, na, nb: links within groups, in proportion to their members (see grouped()), and the sizes of both.

    A group of up to STAR members has its top as centre. A larger one is dealt into parts, as many as its size has a root;
    members are linked with the least of their part, and these with the top. So no centre has more than about STAR members or
    the root of their number.
    """
    link = lambda d, a, b: d.select(F.col(f"{a}.node").alias("a"), F.col(f"{b}.node").alias("b"), F.col(f"{a}.size").alias("na"), F.col(f"{b}.size").alias("nb"))
    members = members.withColumn("own", F.struct("node", "size"))
    large = members.where(F.col("n") > STAR).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.sqrt("n"))))
    parts = large.groupBy(key, "part").agg(F.min("own").alias("least"), F.min("top").alias("top"))
    inner = large.join(parts.drop("top"), [key, "part"])
    out = link(members.where(F.col("n") <= STAR), "top", "own").unionByName(link(parts, "top", "least")).unionByName(link(inner, "least", "own"))
    return out.where("a <> b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, na, nb) whose full sets have 100 * intersection >= percent * union.

    Sizes rule out some before any set moves. A pair carries the set of b to where it meets that of a, which many pairs may
    have; there they are compared at once.
    """
    near = pairs.where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    met = near.join(left, "b").join(right, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")


def _close(percent: int) -> tuple[float, float]:
    """Shares of a set, in ascending order of token frequency, in which two close sets must share a token: of the larger set and of the smaller one."""
    j = percent / 100
    return 1 - j, 1 - 2 * j / (1 + j)


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _apart(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, component) of those groups that hold more than one component."""
    mixed = rows.groupBy(key).agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select(key)
    return rows.join(mixed, key)


def fronts(sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """node, n, p, last, skip, f: of each set of rest the p tokens, rarest first, of which two sets with J >= percent share one.

    f has them without those of one set only, of which there are `skip`, all before f; last is the last one with its frequency.
    """
    tokens = written(sets.join(rest, "node").select("node", "n", F.explode("shingles").alias("w")), "tokens")
    often = tokens.groupBy("w").agg(F.count("*").alias("df"))
    # The rank is the place in the sorted array: no window over whole sets.
    ranked = tokens.join(often, "w").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
    front = F.slice("o", F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * _close(percent)[0] + 1e-9).cast("int") + 1))
    out = ranked.select("node", "n", front.alias("o")).withColumn("f", F.transform(F.filter("o", lambda x: x["df"] > 1), lambda x: x["w"]))
    out = written(out.select("node", "n", F.size("o").alias("p"), F.element_at("o", -1).alias("last"), (F.size("o") - F.size("f")).alias("skip"), "f"), "fronts")
    discard(tokens)
    return out


def agreeing(pairs: DataFrame, front: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fronts have enough in common.

    Of the set whose front ends first, no token of the front is behind the front of the other. So what two sets share is what
    their fronts share, and what is behind the front of that set, at most.
    """
    a, b = (front.select(*[F.col(c).alias(f"{c}{s}" if c != "node" else s) for c in ("node", "n", "p", "last", "f")]) for s in "ab")
    met = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("c", F.size(F.array_intersect("fa", "fb")))
    return met.where(f"(100 + {percent}) * (c + if(lasta <= lastb, na - pa, nb - pb)) >= {percent} * (na + nb)").select("a", "b", "na", "nb")


def _possible(percent: int) -> Column:
    """Whether the smaller set a and b (sizes na, nb) can be close if their first common token has ranks ra and rb."""
    return F.expr(f"100 * na >= {percent} * nb and (100 + {percent}) * (1 + least(na - ra, nb - rb)) >= {percent} * (na + nb)")


def _sides(rows: DataFrame, columns: tuple[str, ...], percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a front as smaller set (a) and as larger one (b); a smaller set needs a shorter front."""
    side = lambda df, s: df.select("w", *[F.col(c).alias(f"{c}{s}") for c in columns])
    return side(rows.where(F.col("r") <= F.ceil(F.col("n") * _close(percent)[1] + 1e-9) + 1), "a"), side(rows, "b")


def _with_partners(front: DataFrame, percent: int) -> DataFrame:
    """The rows of the front (node, n, w, r, component) that sizes and ranks leave a possible partner for.

    Of a token that more than SPLIT sets have, only the sizes and ranks count at first: sets that with no other size and rank
    would do, those that have a frequent passage behind many tokens of their own, are left out.
    """
    front = front.join(front.groupBy("w").agg(F.count("*").alias("of")), "w")
    hot = F.col("of") > SPLIT
    kinds = front.where(hot).select("w", "n", "r").distinct()
    x, y = _sides(kinds, ("n", "r"), percent)
    fit = x.join(y, "w").where((F.col("na") <= F.col("nb")) & _possible(percent))
    fit = fit.select("w", F.inline(F.array(F.struct(F.col("na").alias("n"), F.col("ra").alias("r")), F.struct(F.col("nb").alias("n"), F.col("rb").alias("r"))))).distinct()
    return front.where(~hot).unionByName(front.where(hot).join(fit, ["w", "n", "r"]).select(*front.columns)).drop("of")


def _met(front: DataFrame, percent: int, on: list[str], deal) -> DataFrame:
    """a, b: possible pairs of different components; deal() gives both sides the columns `on`. One of a pair is outside its token's largest component."""
    a, b = deal(*_sides(front, ("node", "n", "r", "component", "of", "minor"), percent))
    ordered = F.expr("na < nb or (na = nb and nodea < nodeb)")
    both = [x.join(y, on).where(ordered & _possible(percent) & F.expr("componenta <> componentb")) for x, y in ((a.where("minora"), b), (a.where("not minora"), b.where("minorb")))]
    return both[0].unionByName(both[1]).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def _some_pairs(front: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs among about `size` sets of a token that a hash puts together."""
    part = lambda s: F.pmod(F.xxhash64(f"node{s}", F.lit(size)), F.ceil(F.col(f"of{s}") / size)).cast("int")
    return _met(front, percent, ["w", "part"], lambda a, b: (a.withColumn("part", part("a")), b.withColumn("part", part("b"))))


def _all_pairs(front: DataFrame, percent: int) -> DataFrame:
    """All pairs. Of a token of more than SPLIT sets, one side is dealt over several tasks and the other goes to each of them."""
    parts = lambda s: F.ceil(F.col(f"of{s}") / SPLIT).cast("int")
    dealt = lambda a, b: (a.withColumn("part", F.pmod(F.xxhash64("nodea"), parts("a")).cast("int")), b.withColumn("part", F.explode(F.sequence(F.lit(0), parts("b") - 1))))
    return _met(front, percent, ["w", "part"], dealt)


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) after further links (a, b): only components are linked anew."""
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    lifted = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = written(components(lifted), "merged")
    old = found.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(old.unionByName(new.join(found.select("node"), "node", "left_anti")), "found")


def _starred(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """found after stars in bands. The first bands link most of what is close, so that in the others only groups of several components have pairs, and only with members of another component than their top."""
    first = written(stars(members.where(F.col("band") < FIRST), "key"), "pairs")
    found = _merged(found, written(confirmed(first, sets, percent), "links"))
    mixed = _apart(_with_components(members.where(F.col("band") >= FIRST), found).drop("top", "n"), "key")
    pairs = stars(grouped(mixed, "key"), "key")
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    return _merged(found, written(confirmed(written(pairs.select("a", "b", "na", "nb"), "pairs"), sets, percent), "links"))


def _searched(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """found after the links that stars may have missed: between sets that met in a band and are in different components.

    Exact for those sets, by prefix and position filters: with tokens ordered by their frequency among these sets (rarest
    first), two sets with J >= percent share a token near the front of both. Tokens that hold one component only are left out.

    Only components count, so not all pairs of a token are looked at: in rounds, each set meets FEW of its token, then
    GROWTH times as many, and sets that turn out to be of one component don't meet again. A set with links to a share of its
    token finds one after as many looks as that share is small; what has none is at last held against all that filters leave.
    """
    rest = written(_apart(_with_components(members.select("key", "node"), found), "key").select("node").distinct(), "rest")
    whole = fronts(sets, rest, percent)
    front = whole.select("node", "n", F.posexplode("f").alias("at", "w"), "skip").select("node", "n", (F.col("at") + F.col("skip") + 1).alias("r"), "w")
    front = written(_with_partners(_apart(_with_components(front, found), "w"), percent), "apart")
    size, last = FEW, False
    while not last:
        held = front.groupBy("w", "component").agg(F.count("*").alias("c"))
        top = held.groupBy("w").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("of"))
        now = front.join(top, "w").withColumn("minor", F.col("component") != F.col("top.component")).drop("top")
        rows, looks = now.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("minor"), F.col("of"))), F.lit(0))).first()
        last = looks <= GROWTH * size * rows
        pairs = written(_all_pairs(now, percent) if last else _some_pairs(now, percent, size), "pairs")
        new = written(confirmed(agreeing(pairs, whole, percent), sets, percent), "links")
        discard(pairs)
        if not new.isEmpty():
            found = _merged(found, new)
            if not last:
                front = written(_apart(_with_components(front.drop("component"), found), "w"), "apart")
        size *= GROWTH
    return found


def _sets_of_members(docs: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """node, shingles of the sets that met another in a band, each made from a document that has it. Few ids are broadcast, so that texts aren't shuffled."""
    nodes = written(classes.join(members.select("node").distinct(), "node").select("node", "c1", "c2", "doc_id"), "nodes")
    ids = written(nodes.select("doc_id").distinct(), "ids")
    own = join_ids(docs, ids, ["doc_id"], "left_semi").select("doc_id", "text")
    made = own.mapInArrow(_plain_sets(k), "c1 long, c2 long, shingles array<long>").dropDuplicates(["c1", "c2"])
    return written(made.join(nodes, ["c1", "c2"]).select("node", F.size("shingles").alias("n"), "shingles"), "sets")


def _same_ids(base: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the sets of rows that share an id."""
    many = base.groupBy("doc_id").agg(F.min("c1").alias("_x"), F.max("c1").alias("_y")).where("_x <> _y").select("doc_id")
    rows = base.join(many, "doc_id").join(classes.select("c1", "c2", "node", "size"), ["c1", "c2"]).select("doc_id", "node", "size").distinct()
    return stars(grouped(rows, "doc_id"), "doc_id").select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: connected groups of texts with 100 * intersection >= percent * union.

    Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z lower-cased. A text of fewer than k words is one
    shingle; null texts and texts without words have none, are linked with nothing and kept. Rows with a null id take no
    part: component_id is null, kept true. Rows that share an id are one document: what is near to either text is linked with
    both, and n_shingles is that of the row's own text. The result doesn't depend on the order of rows.

    Candidates are stars in bands (see stars()), which expand no group into its pairs; what stars leave apart is searched
    exactly, in rounds that look at all pairs only where components stay apart (see _searched()). Links are confirmed on full
    sets of 64-bit hashes of shingles before they count.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(signed_sets(docs, k), "signed")
    base = signed.where("n > 0 and doc_id is not null")
    # A class is a distinct set; its number is fixed when the table is written.
    classes = base.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = written(classes.select("node", "size", F.posexplode("bands").alias("band", "key")), "bands")
    members = written(grouped(banded, "key"), "members")
    discard(banded)
    sets = _sets_of_members(docs, classes, members, k)
    found = components(_same_ids(base, classes))
    found = _searched(members, _starred(members, found, sets, percent), sets, percent)
    of = _with_components(classes.select("node", "c1", "c2", "doc_id"), found)
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "component").select("c1", "c2", "component_id")
    out = signed.drop("bands").join(of, ["c1", "c2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
