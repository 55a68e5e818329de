"""Byte-level BPE over whole partitions by a pair occurrence index.

The distinct pieces of a batch of texts are laid out as one array of symbols. Every adjacent pair that the vocabulary can merge
is indexed by its rank, with all positions where it occurs. Active ranks are taken in ascending order; one step merges all
occurrences of a rank at once and updates the lists of the pairs around them. A merge creates only pairs of higher rank (its
product must exist before it can be part of another), so one ascending sweep gives what merging piece by piece gives.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

#: Where the vocabulary lies unless a query is given another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how the vocabulary's texts were cut into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it starts afresh; bounds its memory, not what it encodes.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """``byte_ids``: id of each byte. Merge k joins ``left[k]`` and ``right[k]`` to ``product[k]``; k is its rank."""

    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    product: np.ndarray


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Vocabulary(
        np.array([ids[c] for c in byte_symbols()], np.int32),
        np.array([ids[a] for a, _ in pairs], np.int64),
        np.array([ids[b] for _, b in pairs], np.int64),
        np.array([ids[a + b] for a, b in pairs], np.int32),
    )


class PairIndexEncoder:
    """Encodes batches of pieces; see the module's head."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        keys = vocabulary.left << 32 | vocabulary.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of_key]
        self.pieces = regex.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.values = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge joins it."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        sym = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        nxt[ends - 1] = -1
        prv[np.concatenate([[0], ends[:-1]])] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, -1, np.int64)  # of the pair that starts here; the last cell takes what has no place
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            found = at[rank[at] >= 0]
            if not len(found):
                return
            found = found[np.argsort(rank[found], kind="stable")]
            r = rank[found]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part in np.split(found, cuts):
                k = int(rank[part[0]])
                if k not in where:
                    where[k] = []
                    heapq.heappush(heap, k)
                where[k].append(part)

        note(inner)
        while heap:
            k = heapq.heappop(heap)
            lists = where.pop(k)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (rank[at] == k)]
            if not len(at):
                continue
            if self.v.left[k] == self.v.right[k]:
                # runs of one symbol: from the left, a position whose partner was just used up is skipped
                at, taken, used = np.sort(at), [], -1
                for p in at.tolist():
                    if p != used:
                        taken.append(p)
                        used = int(nxt[p])
                    else:
                        used = -1
                at = np.array(taken)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.v.product[k]
            alive[gone] = False
            rank[gone] = -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            touched = np.unique(np.concatenate([at, before[before >= 0]]))
            follow = nxt[touched]
            rank[touched] = np.where(follow >= 0, self.ranks(sym[touched], sym[follow]), -1)
            note(touched)
        counts = np.add.reduceat(alive, ends - sizes) if n else np.zeros(0, np.int64)
        return sym[alive].astype(np.int32), counts.astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has. Null and empty texts have none."""
        if len(self.number) > REMEMBERED:
            self.forget()
        cut = [self.pieces.findall(t) if t else [] for t in texts]
        number, fresh = self.number, []
        flat = []
        for words in cut:
            for w in words:
                i = number.get(w)
                if i is None:
                    i = number[w] = len(number)
                    fresh.append(w)
                flat.append(i)
        if fresh:
            values, counts = self.merge_all([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.values = np.concatenate([self.values, values])
        index = np.array(flat, np.int64)
        first, lens = self.starts[index], self.starts[index + 1] - self.starts[index]
        total = int(lens.sum())
        out_first = np.concatenate([[0], np.cumsum(lens)])
        take = np.arange(total) - np.repeat(out_first[:-1] - first, lens)
        text_ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        return self.values[take], np.diff(out_first[text_ends])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(load(path))


def _mapped(df: DataFrame, text: str, out: str, kind: T.DataType, path: str, make) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"column name in the way: {out}")
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            if batch.num_rows:
                ids, counts = coder.encode(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, make(ids, counts)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str, out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of column ``text``, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. Whole texts are encoded, however long; repeated texts give equal lists. An
    empty table gives no rows. A column named ``out`` raises. ``path`` must be readable on every executor.
    """

    def lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))

    return _mapped(df, text, out, T.ArrayType(T.IntegerType()), path, lists)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of column ``text``; as encode, without carrying the ids on."""
    return _mapped(df, text, out, T.LongType(), path, lambda _, counts: pa.array(counts, pa.int64()))
