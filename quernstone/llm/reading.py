"""Reading level of documents, from the levels of their sentences.

Two regularised softmax models, one over character n-grams and one over words, tell the level of a single sentence. They are fitted
on the sentences of labelled documents, first with the document's level for each of its sentences; then sentences are
labelled anew from the models' own opinion together with their document's level, because documents mix levels. A document's
sentence distributions, weighted by length, are averaged, and a small softmax model calibrated on the labelled documents (left
out of the sentence models that score them) turns the average into its level.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Labelled documents that are fitted on at most; the bounded sample is the first by a hash of text.
LABELLED = 20_000
#: Buckets that n-grams and words are hashed to.
CHAR_BUCKETS, WORD_BUCKETS = 1 << 13, 1 << 13
FOLDS = 5
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Words after which a stretch without any mark of punctuation is cut.
LONGEST = 40

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_BREAK = re.compile(r"(?<=[.!?;])\s+|[\n\r  \x0b\x0c]+|<[^>]{0,80}>")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, lower-cased. Digits, punctuation, bullets and markup count for nothing."""
    out = []
    for piece in _BREAK.split(text or ""):
        words = _WORD.findall(piece.lower())
        for i in range(0, len(words), LONGEST):
            if part := words[i : i + LONGEST]:
                out.append(part)
    return out


def _bucket(s: str, buckets: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (buckets - 1)


class Words:
    """Numbers for words, with what is fixed about each: hash, buckets of its n-grams. Starts afresh when it holds too many."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.grams: list[list[int]] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            i = self.number.get(w)
            if i is None:
                i = self.number[w] = len(self.hashes)
                self.hashes.append(zlib.crc32(w.encode("utf-8", "surrogatepass")))
                self.grams.append(char_buckets(w))
            out[k] = i
        return out


def char_buckets(word: str) -> list[int]:
    """Buckets of a word's n-grams of two to four letters with its ends marked, and of its length."""
    s = f"^{word}$"
    return [_bucket(s[i : i + n], CHAR_BUCKETS) for n in (2, 3, 4) for i in range(len(s) - n + 1)] + [_bucket(f"#{min(len(word), 15)}", CHAR_BUCKETS)]


def word_buckets(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, of each with its successor, and which words have a successor in their sentence (``ends``: one past each)."""
    h = hashes.astype(np.uint64)
    single = (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    both = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(13)
    follows = np.ones(len(h), bool)
    follows[ends - 1] = False
    return single, (both & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), follows


def matrices(items: list[list[str]]) -> tuple[tuple, tuple]:
    """Sparse rows (row, bucket, value) of sentences for the character and the word model: counts over the root of their number."""
    words = Words()
    lens = np.array([len(s) for s in items])
    n = words.numbers([w for s in items for w in s])
    row = np.repeat(np.arange(len(items)), lens)
    grams = [words.grams[i] for i in n.tolist()]
    char = _counted(np.repeat(row, [len(g) for g in grams]), np.array([c for g in grams for c in g]), CHAR_BUCKETS, len(items))
    single, both, follows = word_buckets(np.array(words.hashes)[n], np.cumsum(lens))
    inside = follows[:-1]
    return char, _counted(np.concatenate([row, row[:-1][inside]]), np.concatenate([single, both[inside]]), WORD_BUCKETS, len(items))


def _counted(row: np.ndarray, col: np.ndarray, buckets: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, count = np.unique(row * buckets + col, return_counts=True)
    total = np.bincount(row, minlength=n)
    return cell // buckets, cell % buckets, count / np.sqrt(total[cell // buckets])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def times(x: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, n: int) -> np.ndarray:
    at, col, val = x
    return np.stack([np.bincount(at, weights=val * w[col, k], minlength=n) for k in range(w.shape[1])], axis=1)


def fit_sparse(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, buckets: int, penalty: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax model with a squared penalty, by gradient steps with momentum. ``y``: soft labels."""
    at, col, val = x
    n, k = y.shape
    w, b = np.zeros((buckets, k)), np.log(np.maximum((weight[:, None] * y).sum(0), 1e-9) / weight.sum())
    mw, rate, total = np.zeros_like(w), 4.0, weight.sum()
    for _ in range(steps):
        g = (softmax(times(x, w, n) + b) - y) * weight[:, None] / total
        gw = np.stack([np.bincount(col, weights=val * g[at, j], minlength=buckets) for j in range(k)], axis=1) + penalty * w
        mw = 0.9 * mw + gw
        w -= rate * mw
        b -= 0.5 * g.sum(0)
    return w, b


@dataclass
class LevelModel:
    """Everything that scoring needs. ``levels`` are sorted; columns follow them."""

    levels: list[str]
    char: tuple[np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]

    def sentence_levels(self, items: list[list[str]]) -> np.ndarray:
        """Distribution over levels of each sentence (none is empty). A word's n-grams always add the same, which is remembered."""
        words = self._words()
        if len(words.hashes) > REMEMBERED:
            words = self._words(afresh=True)
        lens = np.array([len(s) for s in items])
        n = words.numbers([w for s in items for w in s])
        known = self.__dict__["_sums"]
        if len(known[1]) < len(words.grams):
            new = words.grams[len(known[1]) :]
            starts = np.concatenate([[0], np.cumsum([len(g) for g in new])])[:-1]
            added = np.add.reduceat(self.char[0][[c for g in new for c in g]], starts, axis=0)
            known = self.__dict__["_sums"] = (np.concatenate([known[0], added]), np.concatenate([known[1], [len(g) for g in new]]))
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        zc = np.add.reduceat(known[0][n], starts, axis=0) / np.sqrt(np.add.reduceat(known[1][n], starts))[:, None] + self.char[1]
        single, both, follows = word_buckets(np.array(words.hashes)[n], starts + lens)
        z = self.word[0][single]
        z[:-1] += np.where(follows[:-1, None], self.word[0][both], 0.0)
        zw = np.add.reduceat(z, starts, axis=0) / np.sqrt(2 * lens - 1)[:, None] + self.word[1]
        return softmax((zc + zw) / 2)

    def _words(self, afresh: bool = False) -> Words:
        if afresh or "_known" not in self.__dict__:
            self.__dict__["_known"], self.__dict__["_sums"] = Words(), (np.empty((0, len(self.levels))), np.empty(0))
        return self.__dict__["_known"]

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """Share of each level in each text, by words; even where there is no word."""
        items = [sentences(t) for t in texts]
        flat = [s for d in items for s in d]
        k = len(self.levels)
        out = np.full((len(texts), k), 1.0 / k)
        if flat:
            p = self.sentence_levels(flat)
            doc = np.repeat(np.arange(len(texts)), [len(d) for d in items])
            n = np.array([len(s) for s in flat], float)
            mass = np.bincount(doc, weights=n, minlength=len(texts))
            for j in range(k):
                got = np.bincount(doc, weights=n * p[:, j], minlength=len(texts))
                out[:, j] = np.where(mass > 0, got / np.maximum(mass, 1), out[:, j])
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        w, b = self.calibration
        return softmax(self.profiles(texts) @ w + b)


def _sentence_models(docs: list[list[list[str]]], label: np.ndarray, k: int, rounds: int = 4) -> tuple[tuple, tuple]:
    flat = [s for d in docs for s in d]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    given = np.full((len(flat), k), 0.15 / max(1, k - 1))
    given[np.arange(len(flat)), label[doc]] = 0.85
    n = np.minimum([len(s) for s in flat], 20).astype(float)
    # each level counts alike, however many sentences it has
    weight = n / np.maximum(np.bincount(label[doc], weights=n, minlength=k), 1)[label[doc]]
    weight = weight / weight.mean()
    xc, xw = matrices(flat)
    y = given
    for turn in range(rounds):
        char = fit_sparse(xc, y, weight, CHAR_BUCKETS, 2e-5)
        word = fit_sparse(xw, y, weight, WORD_BUCKETS, 2e-5)
        if turn < rounds - 1:
            p = softmax((times(xc, char[0], len(flat)) + char[1] + times(xw, word[0], len(flat)) + word[1]) / 2)
            # the document's level is a prior of its sentences; the models' opinion of the sentence is the likelihood
            y = p * np.where(given > 0.5, 0.6, 0.4 / max(1, k - 1))
            y /= y.sum(1, keepdims=True)
    return char, word


def _calibrate(profiles: np.ndarray, label: np.ndarray, k: int, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.eye(k) * 4.0, np.zeros(k)
    y = np.eye(k)[label]
    for _ in range(steps):
        g = (softmax(profiles @ w + b) - y) / len(label)
        w -= 1.0 * (profiles.T @ g + 1e-3 * w)
        b -= 1.0 * g.sum(0)
    return w, b


def fit(examples: DataFrame, text: str, level: str) -> LevelModel:
    """A model from labelled documents: all of them, or a fixed sample of ``LABELLED`` if there are more.

    Rows with a null text or level are left out; no row left raises. The order of rows plays no part.
    """
    rows = examples.select(F.col(text).alias("t"), F.col(level).alias("l")).where("t is not null and l is not null")
    rows = rows.orderBy(F.xxhash64("t"), "t", "l").limit(LABELLED).collect()
    if not rows:
        raise ValueError("no labelled document")
    levels = sorted({r["l"] for r in rows})
    label = np.array([levels.index(r["l"]) for r in rows])
    texts, k = [r["t"] for r in rows], len(levels)
    docs = [sentences(t) for t in texts]
    held = np.zeros((len(rows), k))
    folds = np.arange(len(rows)) % FOLDS
    for f in range(FOLDS):
        inside = np.flatnonzero(folds != f)
        if not (folds == f).any() or len({*label[inside].tolist()}) < k:
            held[folds == f] = np.eye(k)[label[folds == f]]
            continue
        char, word = _sentence_models([docs[i] for i in inside], label[inside], k)
        part = LevelModel(levels, char, word, (np.eye(k), np.zeros(k)))
        held[folds == f] = part.profiles([texts[i] for i in np.flatnonzero(folds == f)])
    char, word = _sentence_models(docs, label, k)
    return LevelModel(levels, char, word, _calibrate(held, label, k))


def score(df: DataFrame, text: str, model: LevelModel) -> DataFrame:
    """``df`` with ``reading_level``, ``level_probability`` and ``level_shares`` (share of each level by words, levels sorted).

    A text without a word (null, empty, blank, digits only) has null in all three. Case, punctuation, bullets and line breaks play
    no part beyond where sentences end. Of levels with equal probability the first counts. Columns of these names raise.
    """
    new = ["reading_level", "level_probability", "level_shares"]
    if clash := {*new} & {*df.columns}:
        raise ValueError(f"column names in the way: {sorted(clash)}")
    fields = [T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.ArrayType(T.DoubleType()))]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size, see the buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column(text).to_pylist()
                none = np.array([not _WORD.search(t or "") for t in texts])
                shares = m.profiles(texts)
                w, b = m.calibration
                p = softmax(shares @ w + b)
                best = p.argmax(1)
                columns = [
                    pa.array([None if n else m.levels[j] for n, j in zip(none, best)], pa.string()),
                    pa.array(p.max(1), mask=none),
                    pa.array([None if n else s.tolist() for n, s in zip(none, shares)], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
