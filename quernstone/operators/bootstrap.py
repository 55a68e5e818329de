"""Many seeded draws over an evaluation set, each scored whole in one pass of a Python worker.

The picks are those of ``metrics.resampled`` (MD5 of seed, draw and place), but a draw's picks never become rows: they are counted
into a multiplicity for each row, so nothing of size draws * n is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows times columns that an evaluation set may have: its arrays are collected and broadcast (8 bytes each).
MOST = 10_000_000


#: MD5: how far each step turns, and what it adds.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_CHUNK = 8192


def _heads(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """First four bytes, as a number, of the MD5 of ``n`` messages of one block; ``words``: its 16 words, those that differ as arrays."""
    u = np.uint32
    a, b, c, d = (np.full(n, v, u) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, u), np.empty(n, u)
    for i in range(61):  # the other three steps don't reach the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        f += a
        if isinstance(words[g], int):
            f += u((words[g] + _ADDED[i]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += u(_ADDED[i])
        np.left_shift(f, u(_TURNS[i]), t), np.right_shift(f, u(32 - _TURNS[i]), f), np.bitwise_or(f, t, f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + u(0x67452301)).byteswap()


def _picks(start: bytes, n: int) -> np.ndarray:
    """First four bytes, as a number, of the MD5 of ``start`` and each place below ``n``."""
    out, low = np.empty(n, np.uint32), 0
    while low < n:
        digits = len(str(low))
        high, size = min(n, 10**digits, low + _CHUNK), len(start) + digits
        if size > 55:
            out[low:high] = [int.from_bytes(hashlib.md5(start + b"%d" % j).digest()[:4], "big") for j in range(low, high)]
        else:
            words: list = [*struct.unpack("<16I", (start + bytes(digits) + b"\x80").ljust(56, b"\0") + struct.pack("<Q", 8 * size))]
            j = np.arange(low, high, dtype=np.uint32)
            for place in range(size - 1, len(start) - 1, -1):
                j, digit = np.divmod(j, np.uint32(10))
                words[place // 4] = (digit + np.uint32(48) << np.uint32(8 * (place % 4))) + np.uint32(words[place // 4]) if isinstance(words[place // 4], int) else words[place // 4] + (digit + np.uint32(48) << np.uint32(8 * (place % 4)))
            out[low:high] = _heads(words, high - low)
        low = high
    return out


def multiplicities(seed: str, draw: int, n: int) -> np.ndarray:
    """How often each of ``n`` rows is picked by a draw of ``n`` picks."""
    return np.bincount(_picks(f"{seed}:{draw}:".encode(), n).astype(np.int64) % max(n, 1), minlength=n)


def _runs(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows from the highest score down, and the last place of each run of equal scores."""
    order = np.argsort(-score, kind="stable")
    return order, np.flatnonzero(np.append(np.diff(score[order]) != 0, True)) if len(order) else np.empty(0, np.int64)


def _at_ends(k: np.ndarray, y: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Running number of picks, and of those with the outcome, at every distinct score."""
    order, ends = runs
    drawn = k[order]
    return np.cumsum(drawn)[ends], np.cumsum(drawn * y[order])[ends]


def best_share(k: np.ndarray, y: np.ndarray, runs: tuple[np.ndarray, np.ndarray], target: float) -> float:
    """Largest share that can be decided at a budget in a draw; 0 where no threshold holds it."""
    n_auto, n_false = _at_ends(k, y, runs)
    return float(n_auto[n_false <= target * n_auto].max(initial=0)) / max(int(k.sum()), 1)


def area(k: np.ndarray, y: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> float | None:
    """Area under the ROC curve in a draw, ties counting half; none where it has one outcome only."""
    n_all, n_pos = _at_ends(k, y, runs)
    pos, neg = np.diff(n_pos, prepend=0), np.diff(n_all - n_pos, prepend=0)
    p, n = int(pos.sum()), int(neg.sum())
    return 1 - float((pos * ((n_all - n_pos) - neg / 2)).sum()) / (p * n) if p and n else None


def _draws(rows: DataFrame, order: str, y: str, scores: list[str], draws: int, seed: str, of: Callable, schema: str) -> DataFrame:
    """``of(draw, k, y, {score: runs})`` gives the result rows of a draw."""
    if rows.count() * (len(scores) + 1) > MOST:
        raise ValueError(f"the evaluation set has more than {MOST} values")
    table = rows.select(order, y, *scores).orderBy(order).toArrow()
    outcome = table[y].to_numpy().astype(np.int64)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((outcome, {s: _runs(table[s].to_numpy().astype(float)) for s in scores}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcome, runs = shared.value
        for batch in batches:
            out = [r for d in batch.column(0).to_pylist() for r in of(d, multiplicities(seed, d, len(outcome)), outcome, runs)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[f.split()[0] for f in schema.split(", ")])

    return spark.range(0, draws, 1, min(draws, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def shares(rows: DataFrame, order: str, c: str, y: str, targets: list[float], draws: int, seed: str) -> DataFrame:
    """(draw, target, arr): share decided at each budget, the threshold chosen anew in each draw."""
    return _draws(rows, order, y, [c], draws, seed, lambda d, k, o, runs: [(d, t, best_share(k, o, runs[c], t)) for t in targets], "draw bigint, target double, arr double")


def gains(rows: DataFrame, order: str, y: str, pairs: list[tuple[str, str]], draws: int, seed: str) -> DataFrame:
    """(draw, base, candidate, gain): area of the candidate less that of the base on the same picks. Draws with one outcome have no row."""

    def of(d, k, o, runs):
        areas = {s: area(k, o, r) for s, r in runs.items()}
        return [(d, a, b, areas[b] - areas[a]) for a, b in pairs if areas[a] is not None]

    return _draws(rows, order, y, sorted({s for p in pairs for s in p}), draws, seed, of, "draw bigint, base string, candidate string, gain double")
