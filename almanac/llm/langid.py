"""Language identification: unigram piece models whose word scores sum over all segmentations.

The pieces are those of a fixed public vocabulary; per language each has a probability. A word's likelihood is the sum,
over all ways to cut it into pieces, of the product of their probabilities, computed by the forward algorithm. Models are
fitted by expectation maximisation on word counts of about SAMPLE documents per language.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .buffers import frugal
from .scratch import set_aside, written

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
#: Documents per language that a model is fitted on, chosen by a hash of the id (an expected number; all if there are fewer).
SAMPLE = 2000
#: Characters of a text and of words that are looked at together, and entries of a table of pieces.
PART, BATCH, TABLE = 1 << 18, 1 << 16, 1 << 20
ROUNDS = 3
FLOOR = 1e-7
KEPT = 300_000
#: Characters that regular expressions take for letters although they are numbers (category N).
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD, _NEARLY = re.compile(rf"[^\W\d_{_NUMBERS}]+"), re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str) -> list[str]:
    found = _NEARLY.findall(text.lower())  # much faster than _WORD, and hardly ever different
    return found if all(map(str.isalpha, found)) else [x for w in found for x in _WORD.findall(w)]


def words_of(text: str) -> Iterator[list[str]]:
    """Runs of letters (category L), lower-cased, of PART characters of text or so at a time."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end > at and text[end - 1].isalpha() and text[end].isalpha():
            end -= 1
        if end == at:  # one word; take all of it
            end = _WORD.match(text, at).end()
        yield _words(text[at:end])
        at = end
    yield _words(text[at:])


class Pieces:
    """The vocabulary's pieces of lower-case letters, looked up by hash for many substrings at once."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.text = sorted(p.piece for p in proto.pieces if p.type == 1 and p.piece == p.piece.lower() and re.fullmatch(f"{START}?({_WORD.pattern})?", p.piece))
        self.longest = max(map(len, self.text))
        keys = np.array([self._key(p) for p in self.text], np.uint64)
        order = np.argsort(keys)
        self._keys, self._place = keys[order], order.astype(np.int32)
        # Most hashes are of no piece: a small table of the upper 18 bits tells nearly all of them.
        self._some = np.zeros(1 << 18, bool)
        self._some[keys >> np.uint64(46)] = True

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * _BASE
        return h ^ (h >> np.uint64(29))

    def _key(self, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = self._step(h, np.array([ord(c)], np.uint64))
        return int(h[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes; len(text) where there is none."""
        out = np.full(h.shape, len(self.text), np.int32)
        maybe = np.nonzero(self._some[h >> np.uint64(46)])
        h = h[maybe]
        at = np.minimum(np.searchsorted(self._keys, h), len(self._keys) - 1)
        out[maybe] = np.where(self._keys[at] == h, self._place[at], len(self.text))
        return out

    def from_starts(self, points: np.ndarray, a: int, b: int) -> np.ndarray:
        """Pieces that start at a to b - 1 of each word (a row of code points, filled up with zeros), by word, start and length."""
        part = np.zeros((len(points), b - a + self.longest), np.uint64)
        part[:, : points.shape[1] - a] = points[:, a : b + self.longest]
        h = np.zeros((len(points), b - a), np.uint64)
        out = np.full((*h.shape, self.longest), len(self.text), np.int32)
        for n in range(min(self.longest, points.shape[1] - a)):
            h = h[:, : points.shape[1] - a - n]  # starts that n more characters follow
            h = self._step(h, part[:, n : n + h.shape[1]])
            out[:, : h.shape[1], n] = self.find(h)
        return out

    def to_ends(self, points: np.ndarray, a: int, b: int) -> np.ndarray:
        """Pieces that end at a + 1 to b, by word, end and length."""
        first = max(0, a - self.longest + 1)
        starts = self.from_starts(points, first, b)
        at = np.arange(a + 1, b + 1)[:, None] - np.arange(1, self.longest + 1)
        return np.where(at < first, len(self.text), starts[:, np.maximum(at - first, 0), np.arange(self.longest)])

    def back_to_starts(self, points: np.ndarray, a: int, b: int) -> np.ndarray:
        """The same of words that are written backwards: pieces that start where a + 1 to b characters are left."""
        part = np.zeros((len(points), b - a + self.longest), np.uint64)
        low = max(0, a + 1 - self.longest)
        part[:, self.longest - (a + 1 - low) : self.longest - 1 + b - a] = points[:, low:b]
        h = np.zeros((len(points), b - a), np.uint64)
        out = np.full((*h.shape, self.longest), len(self.text), np.int32)
        for n in range(min(self.longest, b)):
            k = max(0, n - a)  # ends that n more characters come before
            h[:, k:] = self._step(h[:, k:], part[:, self.longest - 1 - n + k : self.longest - 1 - n + b - a])
            out[:, k:, n] = self.find(h[:, k:])
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of about one length (longest first), their lengths with the start mark, and their code points filled up with zeros."""
    lengths = np.array([len(w) for w in words], np.int64) + 1
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        j = min(len(order), i + max(1, BATCH // int(lengths[order[i]])))
        at = order[i:j]
        n = lengths[at]
        points = np.zeros((len(at), int(n[0])), np.uint32)
        points[np.arange(points.shape[1]) < n[:, None]] = np.frombuffer("".join(START + words[k] for k in at.tolist()).encode("utf-32-le"), np.uint32)
        yield at, n, points
        i = j


def _parts(words: int, length: int, longest: int) -> Iterator[tuple[int, int]]:
    step = max(1, TABLE // (words * longest))
    return ((a, min(length, a + step)) for a in range(0, length, step))


def _q(prob: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Probabilities of pieces by length (the last axis of ids), by language or (own) of each word's; single characters at least FLOOR."""
    q = prob[ids] if own is None else prob[ids, own.reshape(-1, *[1] * (ids.ndim - 1))][..., None]
    q[..., 0, :] = np.maximum(q[..., 0, :], FLOOR)
    return q


def _sums(n: np.ndarray, points: np.ndarray, prob: np.ndarray, vocabulary: Pieces, own: np.ndarray | None = None, back: bool = False, every: bool = False) -> np.ndarray:
    """Logs of the forward sums of words, at their ends or (every) at all positions; backward ones if `points` are written backwards.

    All words take a step at a time. Sums are kept for as many positions as a piece is long, and divided by the latest from
    time to time, so that words of any length neither underflow nor take more memory.
    """
    most, k = vocabulary.longest, prob.shape[1] if own is None else 1
    now, scale = np.zeros((len(n), most, k)), np.zeros((len(n), k))
    now[:, -1] = 1
    out = np.zeros((len(n), k))
    rows = np.zeros((len(n), points.shape[1] + 1, k)) if every else None
    for a, b in _parts(len(n), points.shape[1], most):
        live = int(np.searchsorted(-n, -a, "left"))  # words longer than a come first
        table = vocabulary.back_to_starts if back else vocabulary.to_ends
        ids = table(points[:live], a, b)
        sums = np.concatenate((now[:live], np.zeros((live, b - a, k))), axis=1)
        scale = scale[:live]
        for i in range(b - a):
            m = min(most, a + i + 1)  # no piece is longer than what there is
            q = _q(prob, ids[:, i, :m], None if own is None else own[:live])
            v = np.einsum("wmk,wmk->wk", sums[:, most + i - m : most + i][:, ::-1], q)
            sums[:, most + i] = v
            done = n[:live] == a + i + 1
            if every:
                rows[:live, a + i + 1] = np.log(v) + scale
            if done.any():
                out[:live][done] = np.log(v[done]) + scale[done]
            if (a + i) % 16 == 15:
                sums[:, i + 1 : most + i + 1] /= v[:, None]
                scale = scale + np.log(v)
        now = sums[:, -most:]
    return rows if every else out


def log_likelihoods(words: list[str], prob: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """For each word and language the log of the sum over all segmentations. prob: pieces and a last row of zeros, by language."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, n, points in _batches(words):
        out[at] = _sums(n, points, prob, vocabulary)
    return out


def expected_counts(words: list[str], language: np.ndarray, weight: np.ndarray, prob: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """How often each piece is expected in the weighted words, by language: forward and backward sums over all segmentations."""
    out = np.zeros(prob.size)
    for at, n, points in _batches(words):
        own, width = language[at], points.shape[1]
        here = np.arange(width)
        turned = np.where(here < n[:, None], points[np.arange(len(n))[:, None], np.maximum(n[:, None] - 1 - here, 0)], 0)
        ahead = _sums(n, points, prob, vocabulary, own, every=True)[:, :, 0]
        behind = _sums(n, turned, prob, vocabulary, own, back=True, every=True)[:, :, 0]
        total = ahead[np.arange(len(n)), n]
        for a, b in _parts(len(n), width, vocabulary.longest):
            ids = vocabulary.from_starts(points, a, b)
            q = _q(prob, ids, own)[..., 0]
            left = n[:, None, None] - (np.arange(a, b)[:, None] + np.arange(1, vocabulary.longest + 1))
            word, start, size = np.nonzero((left >= 0) & (q > 0))
            left, ids, q = left[word, start, size], ids[word, start, size], q[word, start, size]
            share = np.exp(ahead[word, a + start] + behind[word, left] + np.log(q) - total[word]) * weight[at][word]
            out += np.bincount(ids.astype(np.int64) * prob.shape[1] + own[word], share, len(out))
    out = out.reshape(prob.shape)
    out[-1] = 0
    return out


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for lang, texts in f.groupby("lang")["text"]:
            found = Counter()
            for t in texts:
                for words in words_of(t):
                    found.update(words)
            yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})


def fit(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces + 1, languages) from labelled docs (doc_id, text, lang); nulls are left out.

    What comes to the driver is bounded by the vocabulary and the number of languages.
    """
    docs = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    vocabulary = pieces(path)
    prob = np.full((len(vocabulary.text) + 1, len(langs)), 1 / len(vocabulary.text))
    prob[-1] = 0
    if not langs:
        return langs, prob
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    chosen = docs.where((F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFFFF)) / F.lit(0x1000000)) < share[F.col("lang")])
    counted = written(chosen.select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):

        def expect(frames: Iterator[pd.DataFrame], now: np.ndarray = prob.astype(np.float32)) -> Iterator[pd.DataFrame]:
            total = np.zeros(now.shape)
            for f in frames:
                total += expected_counts(f["word"].tolist(), f["lang"].map(langs.index).to_numpy(), f["n"].to_numpy(), now.astype(float), pieces(path))
            p, k = np.nonzero(total)
            yield pd.DataFrame({"p": p, "k": k, "c": total[p, k]})

        rows = counted.mapInPandas(expect, "p int, k int, c double").groupBy("p", "k").agg(F.sum("c").alias("c")).toPandas()
        new = np.full(prob.shape, 0.01)
        new[-1] = 0
        new[rows["p"].to_numpy(), rows["k"].to_numpy()] += rows["c"].to_numpy()
        prob = new / new.sum(axis=0)
    return langs, prob


class Scorer:
    """Log-likelihoods of texts; those of words are kept while they are few."""

    def __init__(self, prob: np.ndarray, path: str):
        self.prob, self.vocabulary = prob, pieces(path)
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, prob.shape[1]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row per text; nan where it has no letter."""
        out = np.full((len(texts), self.prob.shape[1]), np.nan)
        parts = ((i, words) for i, t in enumerate(texts) for words in words_of(t))
        for some in _together(parts):
            if len(self.place) > KEPT:
                self.place, self.known = {}, self.known[:0]
            place = self.place
            at = [(i, [place.setdefault(w, len(place)) for w in words]) for i, words in some if words]
            if len(place) > len(self.known):
                self.known = np.concatenate((self.known, log_likelihoods(list(islice(place, len(self.known), None)), self.prob, self.vocabulary)))
            for i, a in at:
                out[i] = np.nan_to_num(out[i]) + self.known[a].sum(axis=0)
        return out


def _together(parts: Iterator[tuple[int, list[str]]], size: int = 200_000) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of parts with about `size` words."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += len(part[1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def _predict(langs: list[str], prob: np.ndarray, path: str):
    small = prob.astype(np.float32)

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(small.astype(float), path)
        for f in frames:
            texts = [t or "" for t in f.pop("_text")]
            logs = scorer(texts)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            ok = ~np.isnan(logs[:, 0]) if len(langs) else np.zeros(len(texts), bool)
            if ok.any():
                best = logs[ok].argmax(axis=1)
                lang[ok] = np.array(langs, object)[best]
                score[ok] = 1 / np.exp(logs[ok] - logs[ok].max(axis=1, keepdims=True)).sum(axis=1)
            f["lang_pred"], f["score"] = lang, score
            yield f

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All rows of docs plus lang_pred and score (the share of the likelihood, 0 to 1).

    Only the text is read. Null texts and texts without a letter are `und` with score 0, as is all if the model knows no
    language; of equal likelihoods the first language by name wins. A single character counts FLOOR at least in every language,
    whether it's a piece or not, so that no text has likelihood 0; the masses of a language therefore exceed one by that. Columns named like the added ones are replaced, no others clash.
    """
    docs, (text,), back = set_aside(docs, {"_text"}, text)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    d = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.select(*keep).dtypes)
    return d.mapInPandas(_predict(*model, path), f"{kinds}, lang_pred string, score double").transform(back)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on labelled rows (doc_id, text, lang) that aren't held out, applied to all."""
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
