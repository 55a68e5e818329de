"""Overlap between splits: minwise hashing with banded buckets, kept only where two splits meet, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.linking import BLOCK, class_members, pairs_by_key, verified_links
from quernstone.llm.shingles import SIMILARITY, WORDS, Sets, mix, sequence_sets, sketch_distance
from quernstone.plans.session import checkpointed


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** bands


def banding(similarity: float, recall: float = 0.999, most: int = 28) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which ``recall`` is reached at ``similarity`` in at most ``most`` bands."""
    for rows in range(10, 0, -1):
        for bands in range(1, most + 1):
            if collision(similarity, bands, rows) >= recall:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def band_keys(sets: Sets, bands: int, rows: int, salt: int = 7) -> np.ndarray:
    """Bucket of every text in every band; each holds ``rows`` samples of the set. Zeros for empty sets."""
    samples = sets.samples(1 << (bands * rows - 1).bit_length(), salt)
    out = np.zeros((len(sets.sizes), bands), np.uint64)
    for row in range(rows):
        out = mix(out + samples[:, row * bands : (row + 1) * bands] + np.uint64(row + 1))
    return mix(out ^ np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * (sets.sizes > 0)[:, None].astype(np.uint64)


def _scan(df: DataFrame, id_kind: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, side, cls, cls2, n, odd, s1, s2, keys) of every text; the last three only once for each class and side of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, bool]] = set()
        for b in batches:
            sets = sequence_sets(b.column("text").to_pylist(), words)
            cls = sets.fingerprints().view(np.int64)
            side = b.column("side").to_numpy(zero_copy_only=False).astype(bool)
            fresh = np.zeros(len(cls), bool)
            for i, what in enumerate(zip(cls.tolist(), side.tolist())):
                if what not in met and sets.sizes[i]:
                    met.add(what)
                    fresh[i] = True
            if len(met) > 1_000_000:
                met.clear()
            new = sets.taken(np.flatnonzero(fresh))
            offsets = np.concatenate([[0], np.cumsum(fresh * bands)])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band_keys(new, bands, rows).ravel().view(np.int64)))
            sketch = np.zeros((2, len(cls)), np.int64)
            sketch[:, fresh] = [s.view(np.int64) for s in new.sketches()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("side"), pa.array(cls), pa.array(sets.fingerprints(1).view(np.int64)), pa.array(sets.sizes), sets.parities(), pa.array(sketch[0]), pa.array(sketch[1]), keys],
                names=["id", "side", "cls", "cls2", "n", "odd", "s1", "s2", "keys"],
            )

    return df.mapInArrow(run, f"id {id_kind}, side boolean, cls long, cls2 long, n long, odd array<long>, s1 long, s2 long, keys array<long>")


def cross_split_pairs(df: DataFrame, key: str, text: str, is_eval: Column, words: int = WORDS, similarity: float = SIMILARITY, tuned_for: float | None = None) -> DataFrame:
    """Pairs (eval_id, train_id, jaccard) of an evaluation and a training record with alike texts.

    ``is_eval``: true for evaluation, false for training, null for rows that are neither. Bands are tuned so that pairs of
    similarity ``tuned_for`` (``similarity`` if not given) meet with 0.999. Texts with equal sets are reduced to one on either
    side before they are hashed into buckets, and expanded at the end. Null texts and texts of fewer than ``words`` words are like
    no other. ``key`` must be unique; null keys are left out. Empty tables give no pairs.
    """
    bands, rows = banding(tuned_for or similarity)
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"), is_eval.alias("side")).where("side is not null and id is not null")
    # every text is cut into words and hashed once; all that follows reads what came of it
    scanned = checkpointed(_scan(base, dict(df.dtypes)[key], words, bands, rows))
    members = class_members(scanned.select("id", "side", "cls", "cls2", "n", "odd"))
    keys = scanned.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "cls", "side", "s1", "s2")
    alike = verified_links(members, pairs_by_key(keys, sketch_distance(tuned_for or similarity), sided=True), base, "id", text="text", words=words, similarity=similarity)
    both = alike.unionAll(alike.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    same = members.where("id = rep").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"), "size").where("size > 1").drop("size")
    return _sided(members, both.unionAll(same))


def _sided(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of an evaluation and a training record from ``links`` (a: evaluation's class, b: training's class, jaccard).

    The members of a class and side are cut into blocks, and a link is repeated for every two blocks that have to meet.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    several = members.where("id = rep and size > 1").select("rep", blocks.alias("n"))
    held = members.select("rep", "side", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id")
    out = links
    for end, side, name in (("a", "side", "eval_id"), ("b", "not side", "train_id")):
        # a class that isn't listed has one text, so one block; one without texts on this side finds none
        out = out.join(several.select(F.col("rep").alias(end), "n"), end, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
        out = out.join(held.where(side).select(F.col("rep").alias(end), "block", F.col("id").alias(name)), [end, "block"]).drop("block")
    return out.select("eval_id", "train_id", "jaccard")
