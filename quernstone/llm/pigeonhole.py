"""Near-duplicate records by the generalised pigeonhole principle.

A text is the bit vector of the word sequences it holds. Bits are assigned to partitions: sequences are told apart by their middle
word, whose hash buckets are grouped by how often they occur in the same texts, and each group is split by the sequence's own hash.
Two like texts differ in so few bits that some partitions are bound to be untouched, or likely to be: how many a pair of exactly
the similarity asked for is expected to have untouched is worked out for every partition. Thresholds are unequal: a partition is
unused (-1), or must agree in all its bits (0) of which there are at least so many. Dynamic programming allocates them: least
estimated candidates among the allocations whose expected untouched partitions suffice for ``RECALL``. The estimates are second
moments of the partitions' keys, sketched over all texts. Candidates that share a key are verified: by 64-bit sketches, then by a
bound that never errs, then exactly.

Partitions whose bits may differ in one (threshold 1) would cost a key for every bit; measured, they never pay.

Since similar texts have sizes within a factor of the similarity, sizes are cut into levels of a factor of four, each with its own
number of partitions; a text is entered at its own level, and at the next lower one if a similar text could lie there. Where the
levels begin is fitted to the sizes of all texts, so that few are entered twice.

Texts too short for that have one bit a partition, and the principle in its plain form makes them certain: of the n sequences of a
text at least ceil(similarity * n) are shared, so one of any n - ceil(similarity * n) + 1 is; each text enters its rarest. The same
is done for all texts if certainty is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.linking import Linked, class_members, linked, pairs_by_key
from quernstone.llm.shingles import ANCHOR_BITS, SIMILARITY, WORDS, Sets, mix, sequence_sets, sketch_distance, word_hashes
from quernstone.plans.session import checkpointed

#: Chance with which a pair of exactly the similarity asked for, its edits spread evenly, shares a key. More alike ones have more.
RECALL = 0.9995
#: Hash buckets of middle words, and groups of correlated buckets.
BUCKETS, GROUPS = 256, 4
#: Least bits that a threshold may ask for go from 1 to this.
MOST = 6
#: Cells of the sketch of one partition's keys; its second moment is then known to some 25 %.
CELLS = 32
#: What emitting one key costs, in candidates.
EMIT = 30.0
#: Sizes from one level to the next, and places between them at which levels may begin.
FACTOR, PLACES = 4, 32
#: Cells in which sequences of short texts are counted, to tell the rare ones.
RARITY = 1 << 16
#: Level of the texts that are made certain.
CERTAIN = -1
_NEED = -log(1 - RECALL)
_STEPS = 1000


@dataclass(frozen=True)
class Scheme:
    """Partitions of one level and the least bits in which each must agree; 0: unused. partition = group * split + part of the hash."""

    level: int
    groups: int
    split: int
    least: np.ndarray

    @property
    def partitions(self) -> int:
        return self.groups * self.split


@dataclass(frozen=True)
class Plan:
    """How keys are made: of short texts by rarest sequences (``rarity``: how often each cell was seen), of others by ``schemes``."""

    similarity: float
    tuned: float
    levels: Levels
    group_of: np.ndarray
    schemes: dict[int, Scheme]
    rarity: np.ndarray


@dataclass(frozen=True)
class Levels:
    """Level k holds sizes from base * FACTOR**k up to the next; those below ``first`` are made certain."""

    base: float
    first: int

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Level of each size; -1 for empty sets."""
        return np.where(sizes > 0, np.maximum(0, np.floor(np.log(np.maximum(sizes, 1) / self.base) / log(FACTOR) + 1e-12)), -1).astype(np.int64)

    def low(self, level: float) -> float:
        return self.base * FACTOR**level

    def entered(self, sizes: np.ndarray, tuned: float) -> list[tuple[int, np.ndarray]]:
        """Levels from ``first`` on, and the texts entered there."""
        own = self.of(sizes)
        low = np.minimum(own, self.of(np.ceil(sizes * tuned - 1e-9).astype(np.int64)))
        return [(int(k), (low <= k) & (k <= own)) for k in np.unique(np.concatenate([own, low])) if k >= self.first]

    def short(self, sizes: np.ndarray, similarity: float) -> np.ndarray:
        """The texts that are short themselves or could be like a short one."""
        return (sizes > 0) & (self.of(np.ceil(sizes * similarity - 1e-9).astype(np.int64)) < self.first)

    def shape(self, level: int, tuned: float) -> tuple[int, int] | None:
        return shape(self.low(level), self.low(level + 1), tuned)


def levels_for(sizes: np.ndarray, tuned: float) -> Levels:
    """Levels that begin where fewest texts lie just above; ``sizes[i]`` texts have about ``FACTOR ** (i / PLACES)`` sequences."""
    reach = max(1, round(-log(tuned) / log(FACTOR) * PLACES))  # places within which a text above a beginning is entered twice
    twice = np.zeros(PLACES)
    for i in range(reach):
        np.add.at(twice, (np.arange(len(sizes)) - i) % PLACES, sizes)
    base = FACTOR ** (int(np.argmin(twice)) / PLACES)
    bare = Levels(base, 0)
    return Levels(base, max([k for k in range(12) if bare.shape(k, tuned) is None], default=-1) + 1)


def untouched(partitions: int, size: float, similarity: float, least: int) -> float:
    """Partitions, expected, in which two texts of this size and similarity agree in all bits, of which there are at least ``least``."""
    differ, shared = (2 * size * x / (1 + similarity) / partitions for x in (1 - similarity, similarity))
    term, fewer = exp(-shared), 0.0
    for k in range(least):
        fewer += term
        term *= shared / (k + 1)
    return partitions * exp(-differ) * (1 - fewer)


@lru_cache(maxsize=1024)
def shape(low: float, high: float, similarity: float) -> tuple[int, int] | None:
    """Groups and split of a level: the fewest partitions that leave room for ``RECALL`` at both its ends. None if there is no such number."""
    for split in range(1, int(high / GROUPS) + 2):
        m = GROUPS * split
        if untouched(m, high, similarity, 2) >= 1.3 * _NEED and untouched(m, low, similarity, 1) >= 1.3 * _NEED:
            return GROUPS, split
    return None


def projected(sets: Sets, chosen: np.ndarray, scheme: Scheme, group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``chosen`` texts (their numbers): how many bits each has in each partition, and the hash of these bits."""
    m, docs = scheme.partitions, np.flatnonzero(chosen)
    take = chosen[sets.doc]
    h = sets.hashes[take]
    group = group_of[(mix(sets.anchors[take]) & np.uint64(BUCKETS - 1)).astype(np.int64)] % scheme.groups
    part = group * scheme.split + ((h >> np.uint64(24)) % np.uint64(scheme.split)).astype(np.int64)
    cell = (np.cumsum(chosen) - 1)[sets.doc[take]] * m + part
    n = len(docs) * m
    value = mix(h + np.uint64(0xD1B54A32D192ED03))
    count = np.bincount(cell, minlength=n)
    # sums of halves stay exact as doubles
    low, high = (np.bincount(cell, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.uint64) for v in (value, value >> np.uint64(32)))
    salt = np.tile(mix((np.arange(m) + (scheme.level << 32)).astype(np.uint64)), len(docs))
    keys = mix(mix(low + salt) ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ count.astype(np.uint64))
    return docs, count.reshape(-1, m), keys.reshape(-1, m)


def rarest(sets: Sets, chosen: np.ndarray, similarity: float, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the n - ceil(similarity * n) + 1 rarest sequences of each chosen text; ties go by hash, alike in all texts."""
    take = chosen[sets.doc]
    h, doc = sets.hashes[take], sets.doc[take]
    order = np.lexsort((h, rarity[_rarity_cell(h)], doc))
    h, doc = h[order], doc[order]
    sizes = np.where(chosen, sets.sizes, 0)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = rank < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[doc]
    return doc[keep], mix(h[keep] ^ np.uint64(0xA0761D6478BD642F))


def _rarity_cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(RARITY - 1)).astype(np.int64)


def group_buckets(together: np.ndarray) -> np.ndarray:
    """Group of each bucket: heaviest first, each joins the group with which it correlates most among those with room."""
    mass = np.diag(together).astype(float)
    scale = np.sqrt(np.maximum(np.outer(mass, mass), 1))
    likeness = together / scale
    room = 1.15 * max(mass.sum(), 1) / GROUPS
    group_of, load = np.full(len(mass), -1), np.zeros(GROUPS)
    for b in np.argsort(-mass, kind="stable"):
        best, score = int(np.argmin(load)), -1.0
        for g in range(GROUPS):
            members = np.flatnonzero(group_of == g)
            if load[g] + mass[b] <= room and len(members) and likeness[b, members].mean() > score:
                best, score = g, float(likeness[b, members].mean())
        if (load == 0).any():  # seeds first
            best = int(np.flatnonzero(load == 0)[0])
        group_of[b] = best
        load[best] += max(mass[b], 1e-9)
    return group_of


def allocate(costs: np.ndarray, gains: np.ndarray, need: float) -> np.ndarray:
    """For every partition an option (column), least in total cost among those whose gains sum to ``need``; column 0 is free and gains nothing.

    Gains are rounded down to ``need / _STEPS``. Where even the greatest gains don't reach it, these are taken.
    """
    m, options = costs.shape
    units = np.minimum(np.floor(gains * (_STEPS / need) + 1e-9), _STEPS).astype(np.int64)
    if units.max(axis=1).sum() < _STEPS:
        return gains.argmax(axis=1)
    best = np.full(_STEPS + 1, np.inf)
    best[0] = 0.0
    came = np.zeros((m, _STEPS + 1, 2), np.int64)
    for i in range(m):
        after = np.full(_STEPS + 1, np.inf)
        for o in range(options):
            u, total = units[i, o], best + costs[i, o]
            reached, before = np.full(_STEPS + 1, np.inf), np.arange(_STEPS + 1) - u
            reached[u:] = total[: _STEPS + 1 - u]
            before[-1] = _STEPS - u + int(np.argmin(total[_STEPS - u :]))
            reached[-1] = total[before[-1]]
            better = reached < after
            after[better] = reached[better]
            came[i, better, 0], came[i, better, 1] = o, before[better]
        best = after
    out, at = np.zeros(m, np.int64), _STEPS
    for i in range(m - 1, -1, -1):
        out[i], at = came[i, at]
    return out


def _correlations(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all texts: how often the buckets of words occur in the same ones, and how many have about so many sequences (see ``levels_for``)."""
    places = 32 * PLACES  # sizes up to FACTOR ** 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, sizes = np.zeros((BUCKETS, BUCKETS), np.int64), np.zeros(places, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                w, counts = word_hashes(batch.column("text")[i : i + 1000].to_pylist())
                bucket = (mix(w >> np.uint64(64 - ANCHOR_BITS)) & np.uint64(BUCKETS - 1)).astype(np.int64)
                seen = np.zeros((len(counts), BUCKETS), np.float32)
                seen[np.repeat(np.arange(len(counts)), counts), bucket] = 1
                together += (seen.T @ seen).astype(np.int64)
                n = counts[counts >= words] - words + 1
                sizes += np.bincount((np.log(n) / log(FACTOR) * PLACES).astype(np.int64), minlength=places)
        out = np.concatenate([np.triu(together).ravel(), sizes])
        cells = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(out[cells])], names=["cell", "n"])

    out = np.zeros(BUCKETS * BUCKETS + places, np.int64)
    # at most BUCKETS ** 2 / 2 + places rows, whatever the input
    for r in df.select(F.col(text).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    together = out[: BUCKETS * BUCKETS].reshape(BUCKETS, BUCKETS)
    return np.maximum(together, together.T), out[BUCKETS * BUCKETS :]


_STATS = ["level", "kind", "cell", "x", "y"]


class _Tally:
    """Sums of one task: second moments of keys (kind 0), gains (1), bits in each partition (2), sequences of short texts (3)."""

    def __init__(self, similarity: float, tuned: float, levels: Levels, group_of: np.ndarray) -> None:
        self.similarity, self.tuned, self.levels, self.group_of = similarity, tuned, levels, group_of
        self.sums: dict[tuple[int, int], np.ndarray] = {}

    def _add(self, level: int, kind: int, cell: np.ndarray, x: np.ndarray | None, y: np.ndarray | None, size: int) -> None:
        held = self.sums.setdefault((level, kind), np.zeros((2, size)))
        held[0] += np.bincount(cell, weights=x, minlength=size)
        held[1] += np.bincount(cell, weights=y, minlength=size)

    def add(self, sets: Sets) -> None:
        short = self.levels.short(sets.sizes, self.similarity)[sets.doc]
        if short.any():
            self._add(CERTAIN, 3, _rarity_cell(sets.hashes[short]), None, None, RARITY)
        q = 2 * self.tuned / (1 + self.tuned)
        for level, chosen in self.levels.entered(sets.sizes, self.tuned):
            groups, split = self.levels.shape(level, self.tuned)
            scheme = Scheme(level, groups, split, np.empty(0))
            docs, count, keys = projected(sets, chosen, scheme, self.group_of)
            m = scheme.partitions
            row, part = np.nonzero(count)
            c, k = count[row, part], keys[row, part]
            place = part * MOST + np.minimum(c, MOST) - 1
            self._add(level, 0, place * CELLS + (k % np.uint64(CELLS)).astype(np.int64), np.where((k >> np.uint64(20)) & np.uint64(1), 1.0, -1.0), None, m * MOST * CELLS)
            half = (sets.sizes[docs] >= self.levels.low(level + 0.5)).astype(np.int64)
            self._add(level, 1, half[row] * m * MOST + place, q**c, None, 2 * m * MOST)
            each = np.bincount(half, minlength=2).astype(float)
            self._add(level, 2, half[row] * m + part, c.astype(float), None, 2 * m + 2)
            self.sums[level, 2][0, 2 * m :] += each

    def batch(self, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        parts = [(level, kind, at := np.flatnonzero(held[1] + np.abs(held[0])), held[:, at]) for (level, kind), held in self.sums.items()]
        n = sum(len(p[2]) for p in parts)
        join = lambda values, kind: pa.array(np.concatenate(values) if values else np.empty(0), kind)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int64())),
             join([np.full(len(p[2]), p[0]) for p in parts], pa.int32()), join([np.full(len(p[2]), p[1]) for p in parts], pa.int32()), join([p[2] for p in parts], pa.int32()), join([p[3][0] for p in parts], pa.float64()), join([p[3][1] for p in parts], pa.float64())],
            names=names,
        )


def _profiled(df: DataFrame, key: str, text: str, words: int, similarity: float, tuned: float, levels: Levels, group_of: np.ndarray) -> tuple[DataFrame, Plan]:
    """Each text's class (two hashes of its set), size and parities; and the plan, from sums over all texts."""
    kind = dict(df.dtypes)[key]
    names = ["id", "cls", "cls2", "n", "odd", *_STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, id_type = _Tally(similarity, tuned, levels, group_of), None
        for batch in batches:
            id_type, n = batch.column("id").type, batch.num_rows
            sets = sequence_sets(batch.column("text").to_pylist(), words)
            tally.add(sets)
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets.fingerprints().view(np.int64)), pa.array(sets.fingerprints(1).view(np.int64)), pa.array(sets.sizes), sets.parities(), *nothing], names=names)
        if id_type is not None:
            yield tally.batch(names, id_type)

    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    both = checkpointed(base.mapInArrow(run, f"id {kind}, cls long, cls2 long, n long, odd array<long>, level int, kind int, cell int, x double, y double"))
    sums = both.where("level is not null").groupBy("level", "kind", "cell").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    # second moments are squared sums over the cells of a partition; what reaches the driver are some numbers for each partition of
    # each level, which grow with the longest text only, and at most RARITY counts
    square = F.col("kind") == 0
    at = F.when(square, F.expr(f"cell div {CELLS}")).otherwise(F.col("cell").cast("long"))
    rows = sums.groupBy("level", "kind", at.alias("at")).agg(F.sum(F.when(square, F.col("x") * F.col("x")).otherwise(F.col("x"))).alias("x"), F.sum("y").alias("y")).collect()
    return both.where("level is null").select("id", "cls", "cls2", "n", "odd"), _planned(rows, similarity, tuned, levels, group_of)


def _planned(rows: list, similarity: float, tuned: float, levels: Levels, group_of: np.ndarray) -> Plan:
    rarity, by_level = np.zeros(RARITY), {}
    for level, kind, at, x, y in rows:
        if kind == 3:
            rarity[at] = y
            continue
        groups, split = levels.shape(level, tuned)
        m = groups * split
        tables = by_level.setdefault(level, (np.zeros((m * MOST, 2)), np.zeros(2 * m * MOST), np.zeros(2 * m + 2)))
        if kind == 0:
            tables[0][at] = (x, y)
        else:
            tables[kind][at] = x
    q, schemes = 2 * tuned / (1 + tuned), {}
    for level, (moments, kept, bits) in by_level.items():
        groups, split = levels.shape(level, tuned)
        m = groups * split
        # at least so many bits: sums from the most downwards
        up = lambda t: np.cumsum(t[..., ::-1], axis=-1)[..., ::-1]
        f2, n = up(moments[:, 0].reshape(m, MOST)), up(moments[:, 1].reshape(m, MOST))
        halves = np.maximum(bits[2 * m :], 1e-9)
        alike = up(kept.reshape(2, m, MOST)) / halves[:, None, None] * np.exp(-(1 - q) * bits[: 2 * m].reshape(2, m) / halves[:, None])[..., None]
        gain = np.where(bits[2 * m :, None, None] > 0, alike, np.inf).min(axis=0)
        none = np.zeros((m, 1))
        chosen = allocate(np.hstack([none, np.maximum(0, f2 - n) / 2 + EMIT * n]), np.hstack([none, gain]), _NEED)
        schemes[level] = Scheme(level, groups, split, chosen)
    return Plan(similarity, tuned, levels, group_of, schemes, rarity)


def keys_of(sets: Sets, chosen: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, key) of the chosen texts, level by level."""
    short = chosen & plan.levels.short(sets.sizes, plan.similarity)
    if short.any():
        yield rarest(sets, short, plan.similarity, plan.rarity)
    for level, here in plan.levels.entered(sets.sizes, plan.tuned):
        scheme = plan.schemes[level]
        docs, count, keys = projected(sets, here & chosen, scheme, plan.group_of)
        row, part = np.nonzero((count >= scheme.least) & (scheme.least > 0))
        yield docs[row], keys[row, part]


def _keys(df: DataFrame, text: str, words: int, plan: Plan) -> DataFrame:
    """(key, cls, s1, s2) of every class, once per task: a class met again in the same task gives nothing new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            sets = sequence_sets(batch.column("text").to_pylist(), words)
            cls = sets.fingerprints().view(np.int64)
            fresh = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in met:
                    met.add(c)
                    fresh[i] = True
            if len(met) > 1_000_000:
                met.clear()
            sets, cls = sets.taken(np.flatnonzero(fresh)), cls[fresh]
            s1, s2 = (s.view(np.int64) for s in sets.sketches())
            for doc, k in keys_of(sets, np.ones(len(cls), bool), plan):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(cls[doc]), pa.array(s1[doc]), pa.array(s2[doc])], names=["key", "cls", "s1", "s2"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "key long, cls long, s1 long, s2 long")


def near_duplicates(df: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY, tuned_for: float | None = None, certain: bool = False) -> Linked:
    """Pairs of texts whose sets of ``words`` consecutive words have at least ``similarity`` (Jaccard), as classes and links.

    Every pair found is one. A pair of just the similarity ``tuned_for`` (``similarity`` if not given), edited all over, is found
    with a chance of ``RECALL``, at any length; short texts, and all if ``certain``, share a key for certain, at the cost of more
    keys and far more candidates. Sketches then lose one pair in 300,000 of that similarity.

    Texts with equal sets form a class; see Linked. Null texts and texts of fewer than ``words`` words have no sequences and are
    like no other, equal ones too. ``key`` must be unique and not null; rows with a null key are left out. Further columns play no
    part. Whole texts count, of any length. An empty table gives empty results.
    """
    rows, tuned = df.where(F.col(key).isNotNull()), tuned_for or similarity
    together, sizes = _correlations(rows, text, words)
    levels, group_of = Levels(1.0, 63) if certain else levels_for(sizes, tuned), group_buckets(together)
    profile, plan = _profiled(rows, key, text, words, similarity, tuned, levels, group_of)
    members = class_members(profile)
    return linked(members, pairs_by_key(_keys(rows, text, words, plan), sketch_distance(tuned)), rows, key, text, words, similarity)
