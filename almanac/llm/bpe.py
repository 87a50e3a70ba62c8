"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, wherever it occurs.

Texts are grouped into blocks of bounded size. A block becomes the list of its distinct pre-tokens and, for each text, the
places of its pre-tokens in that list. Only the lists are shuffled by pre-token; one task sees all blocks that hold a
pre-token and encodes it once. The ids go back to the blocks, where texts are put together by position. A pre-token that
is in every text is one entry per block. Long texts are split and digested a part at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import frugal

MULTILINGUAL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK = 16 << 20
#: Pre-tokens of a text, and tokens of a digest, that are looked at together.
PART = 1 << 20
#: Distinct pre-tokens whose ids a task keeps at once.
KEPT = 400_000
#: White_Space as the tokenizer's own regular expressions have it; regex's own class adds U+001C-001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_X = "block long, words binary, ids binary, nulls binary, lengths binary, codes binary"


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of one pre-token; it is matched whole."""
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@lru_cache(2)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


def _codes(text: str, split: regex.Pattern, seen: dict[str, int]) -> np.ndarray:
    """Places of the text's pre-tokens in seen, which grows by those that are new."""
    if len(text) <= PART:
        found = split.findall(text)
        return np.fromiter(map(seen.__getitem__, found), np.uint32, len(found))
    found, parts = (m.group() for m in split.finditer(text)), []
    while not parts or len(parts[-1]) == PART:
        parts.append(np.fromiter(map(seen.__getitem__, islice(found, PART)), np.uint32))
    return np.concatenate(parts)


def _pack(codes: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that the mostly empty high bytes cost nothing."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(words), 3)


def _unpack_words(data: bytes) -> list[bytes]:
    n = 4 + int.from_bytes(data[:4], "little")
    ends, flat = np.cumsum(_unpack(data[4:n]).astype(np.int64)).tolist(), zstandard.decompress(data[n:])
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(pattern: str, block: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.array([0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()])
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // block, prepend=0))
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                if a == b:
                    continue
                seen: dict[str, int] = defaultdict(count().__next__)
                codes = []
                for t in texts.slice(a, b - a):
                    codes.append(_codes(t.as_py() or "", split, seen))
                words = [w.encode() for w in seen]
                own = ids.slice(a, b - a)
                raw = pa.compute.fill_null(own, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                nulls = np.array(own.is_null()).astype(np.uint8).tobytes()
                packed = _pack(np.concatenate(codes))
                key = hashlib.blake2b(digest_size=8)
                packed_words = _pack_words(words)
                for part in (raw, nulls, packed, packed_words):
                    key.update(part)
                # The block is named by what it holds: a task that runs again names it alike.
                name = int.from_bytes(key.digest(), "little", signed=True)
                lengths = np.array([len(c) for c in codes], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in (packed_words, raw, nulls, lengths, packed))], names=["block", "words", "ids", "nulls", "lengths", "codes"])

    return run


def _deal(buckets: int):
    """A block's words by the hash of the word, with their places."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _unpack_words(words.as_py())
                key = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(key, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([int(key[part[0]])]), pa.array([_pack(np.diff(part, prepend=0))], pa.binary()), pa.array([_pack_words([words[i] for i in part.tolist()])], pa.binary())], names=["block", "bucket", "places", "words"]
                        )

    return run


def _encode(path: str):
    """Ids of dealt words. Each is encoded once, unless a bucket holds more than KEPT distinct ones."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for name, places, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                sizes, flat = [], []
                for w in _unpack_words(words.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= KEPT:
                            known.clear()
                        ids = known[w] = tuple(encode(w.decode()))
                    sizes.append(len(ids))
                    flat.extend(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in (places, _pack(np.array(sizes, np.uint32)), _pack(np.array(flat, np.uint32))))], names=["block", "places", "sizes", "flat"])

    return run


def _together(finish: Callable[[list[np.ndarray]], dict]):
    def run(blocks: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.drop_duplicates("places")  # the same rows twice make the same block twice
        places = [np.cumsum(_unpack(p).astype(np.int64)) for p in entries["places"]]
        n = sum(map(len, places))
        sizes, start, flat, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for p, size, ids in zip(places, entries["sizes"], entries["flat"], strict=True):
            s, f = _unpack(size).astype(np.int64), _unpack(ids)
            sizes[p], start[p] = s, at + np.cumsum(s) - s
            flat.append(f)
            at += len(f)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        out = []
        for ids, nulls, lengths, codes in zip(blocks["ids"], blocks["nulls"], blocks["lengths"], blocks["codes"], strict=True):
            codes = _unpack(codes)
            ends = np.cumsum(np.frombuffer(lengths, np.int64))
            tokens = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                c = codes[a:b]
                n = sizes[c]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                tokens.append(flat[np.repeat(start[c], n) + inner].astype(np.int32))
            doc = pd.Series(np.frombuffer(ids, np.int64)).astype("Int64").mask(np.frombuffer(nulls, np.uint8) > 0)
            out.append(pd.DataFrame({"doc_id": doc, **finish(tokens)}))
        return pd.concat(out)

    return run


def _plain(tokens: list[np.ndarray]) -> dict:
    return {"n_tokens": [len(t) for t in tokens], "ids": tokens}


def _digests(path: str):
    def finish(tokens: list[np.ndarray]) -> dict:
        vocabulary = _tokens(path)
        decimal = [str(i) for i in range(len(vocabulary))]
        ids, texts = [], []
        for t in tokens:
            x, y = hashlib.sha256(), hashlib.sha256()
            for a in range(0, len(t), PART):
                part = t[a : a + PART].tolist()
                x.update(("," * (a > 0) + ",".join(map(decimal.__getitem__, part))).encode())
                y.update(b"".join(map(vocabulary.__getitem__, part)))
            ids.append(x.hexdigest())
            texts.append(y.hexdigest())
        return {"n_tokens": [len(t) for t in tokens], "ids_sha256": ids, "decoded_sha256": texts}

    return finish


def encode(docs: DataFrame, path: str = MULTILINGUAL, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, finish: Callable | None = None, added: str = "n_tokens long, ids array<int>") -> DataFrame:
    """doc_id, n_tokens, ids for every row. A null text counts as empty and has no ids; rows that are repeated are encoded each, null ids stay null.

    finish, with the columns it adds, turns the id arrays of a block into other columns where they are made.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both uses of the blocks read one shuffle; each takes all columns, so that the plans below it stay equal.
    blocks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_blocks(pattern, block), _X).repartition(n, "block")
    dealt = blocks.mapInArrow(_deal(n), "block long, bucket long, places binary, words binary").repartition(n, "bucket")
    entries = dealt.mapInArrow(_encode(path), "block long, places binary, sizes binary, flat binary")
    return blocks.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(_together(finish or _plain), f"doc_id long, {added}")


def encode_digests(docs: DataFrame, path: str = MULTILINGUAL, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)."""
    return encode(docs, path, finish=_digests(path), added="n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


@lru_cache(2)
def _tokens(path: str) -> list[bytes]:
    """Bytes by id: the token-byte table."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def _decode(path: str):
    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _tokens(path)
        for f in frames:
            f["decoded"] = [b"" if ids is None else b"".join([vocabulary[i] for i in ids]) for ids in f["ids"]]
            yield f

    return run


def decode(encoded: DataFrame, path: str = MULTILINGUAL) -> DataFrame:
    """encoded (with ids) plus decoded (binary). A null array decodes to nothing; an id outside the vocabulary is an error. The token-byte table is a fixed file, so its size is bounded."""
    plain = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    kinds = ", ".join(f"`{n}` {k}" for n, k in plain.dtypes)
    return plain.mapInPandas(_decode(path), f"{kinds}, decoded binary")
