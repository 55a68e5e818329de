"""From shared keys to verified links between classes of equal texts, and from links to groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.shingles import may_reach, verified
from quernstone.plans.session import checkpointed

#: Classes under one key that one task pairs at once; larger groups are cut into blocks of this size.
BLOCK = 256
#: Rows under one key that are paired as they pass; what a task holds at once.
TOGETHER = 1024


@dataclass(frozen=True)
class Linked:
    """``members``: (id, rep, size) for every text with sequences; ``rep`` is the least id of its class, which has ``size`` texts.
    ``links``: (a, b, jaccard) between representatives of different classes, a < b, once each."""

    members: DataFrame
    links: DataFrame


def class_members(profile: DataFrame) -> DataFrame:
    """``profile`` (id, cls, cls2, n, ...) of the texts with sequences, with the least id of the class (rep) and its size.

    Texts are of one class if both hashes of their sets agree. A class may hold a third of all rows: it is reduced before it is
    joined back.
    """
    some = profile.where("n > 0")
    least = some.groupBy("cls", "cls2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    # only classes with several members go through the join; their rows spread over salts, each salt with a copy of the class
    salts = 16
    many = least.where("size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = some.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = salted.join(many, ["cls", "cls2", "salt"], "left")
    return checkpointed(joined.select(*profile.columns, F.coalesce("rep", "id").alias("rep"), F.coalesce("size", F.lit(1)).alias("size")).drop("cls2"))


def pairs_by_key(keys: DataFrame, apart: int, sided: bool = False) -> DataFrame:
    """Distinct pairs (x, y) of classes that share a key and whose sketches differ in at most ``apart`` bits, from (key, cls, s1, s2).

    x < y; with ``sided``, ``keys`` has a boolean ``side``, and x is of a true row, y of a false one. Keys are moved and sorted
    once; groups of up to ``TOGETHER`` rows are paired as they pass, larger ones stream on to be cut into blocks. Every two blocks
    that have to meet then do so under a key of their own, so that pairing a group is spread over tasks, none holds a whole
    group, and none of its pairs is left out.
    """
    columns = ["key", "cls", "s1", "s2"] + ["side"] * sided

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairing = _Pairing(apart, sided)
        for batch in batches:
            yield from pairing.take([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        yield from pairing.take(None)

    moved = keys.select(columns).repartition("key").sortWithinPartitions("key")
    met = checkpointed(moved.mapInArrow(run, "key long, x long, y long, s1 long, s2 long, side boolean"))
    few = met.where("key is null").select("x", "y")
    many = met.where("key is not null").select("key", F.col("x").alias("cls"), "s1", "s2", "side").distinct()
    if met.where("key is not null").limit(1).count():
        few = few.unionAll(_pairs_in_blocks(many, apart, sided))
    return few.distinct()


class _Pairing:
    """Pairs rows of equal keys that come sorted by key, a batch at a time. The last key of a batch waits for more of its rows."""

    def __init__(self, apart: int, sided: bool) -> None:
        self.apart, self.sided = apart, sided
        self.held: list[np.ndarray] | None = None
        self.large: int | None = None  # the key whose rows are passed on

    def take(self, rows: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        last, held = rows is None, self.held
        if rows is None or held is None:
            rows = held if rows is None else rows
        else:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        self.held = None
        if rows is None or not len(rows[0]):
            return
        key = rows[0]
        if self.large is not None:
            n = int(np.searchsorted(key, self.large, "right"))
            yield self._out([c[:n] for c in rows])
            rows = [c[n:] for c in rows]
            key = rows[0]
            if not len(key):
                return
            self.large = None
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        if not last:
            if size[-1] > TOGETHER:
                self.large = int(key[-1])
            else:
                self.held = [c[begin[-1] :] for c in rows]
                rows = [c[: begin[-1]] for c in rows]
                begin, size = begin[:-1], size[:-1]
        each = np.repeat(size, size)
        if (each > TOGETHER).any():
            yield self._out([c[each > TOGETHER] for c in rows])
        use = (each > 1) & (each <= TOGETHER)
        left = (np.repeat(begin + size, size) - 1 - np.arange(len(each)))[use]  # rows of the same key behind this one
        _, cls, s1, s2, *side = (c[use] for c in rows)
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
        i, found = np.flatnonzero(left), []
        for d in range(1, TOGETHER):
            i = i[left[i] >= d]
            if not len(i):
                break
            j = i + d
            near = np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j]) <= self.apart
            near &= cls[i] != cls[j]
            if self.sided:
                near &= side[0][i] != side[0][j]
            if near.any():
                x, y = i[near], j[near]
                swap = ~side[0][x].astype(bool) if self.sided else cls[x] > cls[y]
                found.append(np.stack([cls[np.where(swap, y, x)], cls[np.where(swap, x, y)]]))
        if found:
            x, y = np.unique(np.concatenate(found, axis=1), axis=1)
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(x), pa.array(y), none, none, pa.nulls(len(x), pa.bool_())], names=_MET)

    def _out(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, s1, s2, *side = rows
        flag = pa.array(side[0].astype(bool)) if self.sided else pa.nulls(len(key), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.nulls(len(key), pa.int64()), pa.array(s1), pa.array(s2), flag], names=_MET)


_MET = ["key", "x", "y", "s1", "s2", "side"]


def _pairs_in_blocks(shared: DataFrame, apart: int, sided: bool) -> DataFrame:
    """Pairs of rows of equal keys, from (key, cls, s1, s2, side), for keys with very many rows, which are counted by partial sums."""
    near = F.bit_count(F.col("xs1").bitwiseXOR(F.col("ys1"))) + F.bit_count(F.col("xs2").bitwiseXOR(F.col("ys2"))) <= apart
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int").alias(n)
    if not sided:
        counted = shared.join(shared.groupBy("key").agg(F.count("*").alias("blocks")).select("key", blocks("blocks")), "key")
        left, right = _blocks_that_meet(counted, "cls", ["key"], ["s1", "s2"])
        # x from the lower block, y from the higher; within one block each pair once
        pairs = left.join(right, ["key", "lo", "hi"]).where("lo < hi or x0 < y0").where(near)
        return pairs.select(F.least("x0", "y0").alias("x"), F.greatest("x0", "y0").alias("y")).where("x <> y")
    counts = shared.groupBy("key").agg(F.count_if("side").alias("b_true"), F.count_if(~F.col("side")).alias("b_false"))
    counted = shared.join(counts.where("b_true > 0 and b_false > 0").select("key", blocks("b_true"), blocks("b_false")), "key")
    pick = lambda c, n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int").alias(c)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda name: [F.col("cls").alias(f"{name}0"), F.col("s1").alias(f"{name}s1"), F.col("s2").alias(f"{name}s2")]
    left = counted.where("side").select("key", pick("lo", "b_true"), each("b_false").alias("hi"), *of("x"))
    right = counted.where("not side").select("key", each("b_true").alias("lo"), pick("hi", "b_false"), *of("y"))
    return left.join(right, ["key", "lo", "hi"]).where(near).where("x0 <> y0").select(F.col("x0").alias("x"), F.col("y0").alias("y"))


def _blocks_that_meet(df: DataFrame, item: str, group: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides whose join on (group, lo, hi) brings every two blocks of a group together; a group has ``blocks`` of them.

    Pairs x0, y0 with lo < hi, or within one block with x0 < y0, are the group's pairs, each once.
    """
    own = df.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    meet = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    side = lambda at, name: meet.where(f"own = {at}").select(*group, "lo", "hi", F.col(item).alias(f"{name}0"), *(F.col(c).alias(name + c) for c in more))
    return side("lo", "x"), side("hi", "y")


def verified_links(members: DataFrame, pairs: DataFrame, texts: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (x, y) of classes that reach ``similarity``, a < b being their representatives.

    First sizes and bits rule out all that cannot (see ``may_reach``), then texts are compared.
    """
    reps = members.where("id = rep").select("cls", "rep", "n", "odd")
    named = lambda c: reps.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
    left = pairs.join(named("x"), "x").join(named("y"), "y").where(may_reach("x", "y", similarity))
    candidates = checkpointed(left.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct())
    return checkpointed(verified(candidates, texts, key, text, words, similarity))


def linked(members: DataFrame, pairs: DataFrame, texts: DataFrame, key: str, text: str, words: int, similarity: float) -> Linked:
    """Verify pairs of classes by the texts of their representatives."""
    return Linked(members.select("id", "rep", "size"), verified_links(members, pairs, texts, key, text, words, similarity))


def expanded(found: Linked) -> DataFrame:
    """All pairs (id_1, id_2), id_1 < id_2, of alike texts: within classes, and between linked ones.

    The members of a class are cut into blocks, which meet under keys of their own, so that no task pairs a whole class.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    several = found.members.where("size > 1").select("id", "rep", blocks.alias("blocks"))
    left, right = _blocks_that_meet(several, "id", ["rep"], [])
    within = left.join(right, ["rep", "lo", "hi"]).where("lo < hi or x0 < y0").select(F.col("x0").alias("i"), F.col("y0").alias("j"))
    # classes of one text need no look-up: the text is its own representative
    sizes = several.where("id = rep").select("rep", "blocks")
    held = several.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    between = found.links.select("a", "b")
    for end, name in (("a", "i"), ("b", "j")):
        of = sizes.select(F.col("rep").alias(end), F.col("blocks").alias("n"))
        between = between.join(of, end, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
        between = between.join(held.select(F.col("rep").alias(end), F.col("own").alias("block"), F.col("id").alias(name)), [end, "block"], "left")
        between = between.where(F.col(name).isNotNull() | F.col("n").isNull()).withColumn(name, F.coalesce(name, end)).drop("block", "n")
    return within.unionAll(between.select("i", "j")).select(F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2"))


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, group) for every id in ``links`` (a, b): the least id it is connected to.

    Every id takes the least label among its own and its neighbours', then the label of its label, until nothing changes; the
    second step halves distances, so a long chain takes few rounds. Raises when ``rounds`` are not enough.
    """
    edges = checkpointed(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    for _ in range(rounds):
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("group").alias("near"))
        stepped = labels.join(near, F.col("id") == F.col("a")).select("id", "group", F.least("group", "near").alias("step"))
        of = stepped.select(F.col("id").alias("via"), F.col("step").alias("jump"))
        jumped = stepped.join(of, F.col("step") == F.col("via")).select("id", F.least("step", "jump").alias("new"), "group")
        after = checkpointed(jumped)
        changed = after.where("new <> group").limit(1).count()
        labels = after.select("id", F.col("new").alias("group"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
