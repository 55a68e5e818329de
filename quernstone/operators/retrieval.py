"""Earlier similar texts under guards: TF-IDF by group, a pool of the most similar, and a walk down the pool."""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, TimestampType

from quernstone.plans.session import checkpoint_dir, default_tasks

# Neighbours looked at for each wanted, least similarity, and similarity at which two count as one event.
POOL, LEAST, SAME_EVENT = 8, 0.10, 0.90
#: Of the pool after the guards, so many are walked first.
FIRST = 8
#: Terms that are broadcast at most, queries a block, terms scored as columns, pairs scored and products added at once, most that single precision errs.
MOST_TERMS, SLICE, COLUMNS, CELLS, STEP, SLACK = 20_000_000, 8192, 1000, 4_000_000, 100_000, 1e-4

_ACCENTED = {chr(i): d[0] for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(i))) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(c) for c in d[1:])}


def plain(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    lower = F.lower(text)
    return F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, "".join(_ACCENTED), "".join(_ACCENTED.values()))).otherwise(lower)


def terms(text: Column, pairs: bool = True) -> Column:
    """Words of two and more letters or digits, and (``pairs``) neighbouring two."""
    words = F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    if not pairs:
        return words
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    # two shifted copies side by side: the words are cut once a copy, not once a pair
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))


def counts(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, term, tf)."""
    return df.select(group, key, F.explode(terms(F.col(text))).alias("term")).groupBy(group, key, "term").agg(F.count("*").alias("tf"))


def vocabulary(postings: DataFrame, group: str, sizes: DataFrame, least_df: int) -> DataFrame:
    """(group, term, idf) of the terms in at least ``least_df`` texts of the group."""
    df = postings.groupBy(group, "term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    return df.join(F.broadcast(sizes), group).select(group, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # sizes: a row a group


def weighted(postings: DataFrame, vocab: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, term, w): (1 + ln tf) * idf over the text's length. Terms outside the vocabulary are dropped."""
    raw = postings.join(vocab, [group, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(group, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [group, key]).select(group, key, "term", (F.col("w") / F.col("norm")).alias("w"))


def hashed(text: Column) -> Column:
    """64-bit hashes of the words, in order."""
    return F.transform(terms(text, pairs=False), lambda w: F.xxhash64(w))


def _all_terms(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and every two neighbouring words."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    beside = row[1:] == row[:-1]
    a, b = flat[:-1][beside], flat[1:][beside]
    two = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)  # order counts
    two = (two ^ (two >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([row, row[1:][beside]]), np.concatenate([flat, two ^ (two >> np.uint64(32))])


def _vectors(words: pa.ListArray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf, weight) of the terms in ``known`` (ascending hashes, idf), by row and code; each row's weights have length 1."""
    hashes, idf = known
    row, h = _all_terms(words)
    code = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
    hit = hashes[code] == h if len(hashes) else np.zeros(len(h), bool)
    both, tf = np.unique(row[hit] * len(hashes) + code[hit], return_counts=True)
    row, code = np.divmod(both, max(len(hashes), 1))
    w = (1 + np.log(tf)) * idf[code]
    return row, code, tf, w / np.sqrt(np.bincount(row, w * w, len(words)))[row]


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two vectors as (ascending codes, weights)."""
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float((a[1] * b[1][at])[b[0][at] == a[0]].sum())


def _written(df: DataFrame, *by: str) -> DataFrame:
    """Rows in the shared folder as Parquet, which takes a fraction of a checkpoint's space; a folder a value of ``by``."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/retrieval-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frequencies(corpus: DataFrame) -> DataFrame:
    """(g, h, df): in how many texts of a group each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = defaultdict(list), 0

        def out():
            for g, parts in found.items():
                h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["g", "h", "df"])

        for batch in batches:
            for g in pc.unique(batch["g"]).to_pylist():
                row, h = _all_terms(batch.filter(pc.equal(batch["g"], g))["words"])
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                first = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
                h, n = np.unique(h[first], return_counts=True)
                found[g].append((h, n))
                size += len(h)
            if size > 4_000_000:
                yield from out()
                found, size = defaultdict(list), 0
        yield from out()

    return corpus.select("g", "words").mapInArrow(run, "g string, h bigint, df bigint").groupBy("g", "h").agg(F.sum("df").alias("df"))


def _known(corpus: DataFrame, least_df: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """group -> (ascending hashes, idf) of the terms in at least ``least_df`` texts of the group."""
    sizes = {r["g"]: r["n"] for r in corpus.groupBy("g").agg(F.count("*").alias("n")).collect()}
    kept = _written(_frequencies(corpus).where(F.col("df") >= least_df))
    if (n := kept.count()) > MOST_TERMS:
        raise ValueError(f"the corpus has {n} terms in {least_df} texts or more; at most {MOST_TERMS} are broadcast")
    table, out = kept.toArrow(), {}
    for g, n in sizes.items():
        own = table.filter(pc.equal(table["g"], g))
        h, df = own["h"].to_numpy().view(np.uint64), own["df"].to_numpy()
        order = np.argsort(h)
        out[g] = h[order], np.log((1 + n) / (1 + df[order])) + 1
    return out


class _Asked:
    """A group's queries: the terms that cost most as columns of a matrix, the others as lists of (query, weight) by term."""

    def __init__(self, words: pa.ListArray, known: tuple[np.ndarray, np.ndarray]):
        self.n = len(words)
        row, code, _, w = _vectors(words, known)
        n_asked = np.bincount(code, minlength=len(known[0]))
        # idf falls with the number of texts, so that number of texts times number of queries orders terms by their pairs
        pairs = n_asked * np.exp(-known[1])
        top = np.argsort(-pairs, kind="stable")[:COLUMNS]
        self.column = np.full(len(known[0]), -1, np.int32)
        self.column[top[n_asked[top] > 0]] = np.arange((n_asked[top] > 0).sum())
        common = self.column[code] >= 0
        self.dense = np.zeros((self.n, max(int(self.column.max(initial=-1)) + 1, 1)))
        self.dense[row[common], self.column[code[common]]] = w[common]
        self.single = self.dense.astype(np.float32)
        order = np.argsort(code[~common], kind="stable")
        self.rows, self.w = row[~common][order].astype(np.int32), w[~common][order]
        self.start = np.append(0, np.cumsum(np.bincount(code[~common], minlength=len(known[0])))).astype(np.int64)


class _Texts:
    """The corpus as vectors in files of Parquet, by group. Files that every machine reads by their path are read there; others are sent to each."""

    def __init__(self, stored: DataFrame):
        self.files, self.root, names = defaultdict(list), None, sorted(stored.inputFiles())
        if not all(n.startswith("file:") for n in names):
            root = names[0][: re.search(r"/number=\d+/", names[0]).start()]
            stored.sparkSession.sparkContext.addFile(root, recursive=True)
            self.root = root.rsplit("/", 1)[1]
        for n in names:
            path = unquote(urlparse(n).path)
            at = re.search(r"/number=(\d+)/", path)
            self.files[int(at[1])].append(path if self.root is None else path[at.start() + 1 :])

    def read(self, group: int, rows: int, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(number of the first, texts): at most ``rows`` at a time, always in the same order."""
        first = 0
        for path in self.files[group]:
            with pq.ParquetFile(path if self.root is None else os.path.join(SparkFiles.get(self.root), path)) as file:
                for batch in file.iter_batches(rows, columns=columns):
                    yield first, batch
                    first += len(batch)

    def chosen(self, group: int, rows: int, columns: list[str], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        """The texts of the numbers ``wanted`` (ascending), with them."""
        for first, batch in self.read(group, rows, columns):
            some = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + len(batch))]
            if len(some):
                yield some, batch.take(pa.array(some - first))


def _store(corpus: DataFrame, shared: Broadcast, numbers: dict[str, int], most: int) -> DataFrame:
    """(number, key, day, mark, sign, step, tf): texts as ascending codes (their differences) and counts; without terms, none.

    Of equal vectors only the first ``most`` keys are kept: no others can be among the nearest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in pc.unique(batch["g"]).to_pylist():
                own = batch.filter(pc.equal(batch["g"], g))
                row, code, tf, _ = _vectors(own["words"], shared.value[g])
                with np.errstate(over="ignore"):
                    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ tf.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                    sign = np.zeros(len(own), np.uint64)
                    np.add.at(sign, row, mixed ^ (mixed >> np.uint64(32)))
                n = np.bincount(row, minlength=len(own))
                start = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                step = np.where(np.append(True, row[1:] != row[:-1])[: len(row)], code, np.diff(code, prepend=0)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(start, pa.array(x)) for x in (step, tf.astype(np.int32))]
                numbered = pa.array(np.full(len(own), numbers[g], np.int32))
                out = pa.RecordBatch.from_arrays([numbered, own["key"], own["day"], own["mark"], pa.array(sign.view(np.int64)), *lists], names=["number", "key", "day", "mark", "sign", "step", "tf"])
                yield out.filter(pa.array(n > 0))

    stored = _written(corpus.mapInArrow(run, f"number int, key string, day {corpus.schema['day'].dataType.simpleString()}, mark string, sign bigint, step array<int>, tf array<int>"), "number")
    many = stored.groupBy("number", "sign").agg(F.count("*").alias("n")).where(F.col("n") > most).select("number", "sign")
    if many.isEmpty():
        return stored
    place = F.row_number().over(Window.partitionBy("number", "sign").orderBy("key"))
    first = stored.join(many, ["number", "sign"], "left_semi").withColumn("place", place).where(F.col("place") <= most).select(stored.columns)
    return _written(stored.join(many, ["number", "sign"], "left_anti").select(stored.columns).unionByName(first), "number")


def _unpacked(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of stored texts."""
    n = batch["step"].value_lengths().to_numpy()
    row, total = np.repeat(np.arange(len(batch)), n), np.cumsum(batch["step"].flatten().to_numpy(), dtype=np.int64)
    before = np.append(0, total)[np.append(0, np.cumsum(n)[:-1])]  # every text has terms
    code = total - before[row]
    w = (1 + np.log(batch["tf"].flatten().to_numpy())) * idf[code]
    return row, code, w / np.sqrt(np.bincount(row, w * w, len(batch)))[row]


def _columns(asked: _Asked, n: int, row: np.ndarray, code: np.ndarray, w: np.ndarray, kind: type) -> np.ndarray:
    """The terms that are columns of ``asked``, a row a text."""
    column = asked.column[code]
    common = column >= 0
    out = np.zeros((n, asked.dense.shape[1]), kind)
    out[row[common], column[common]] = w[common]
    return out


def _scores(asked: _Asked, n: int, row: np.ndarray, code: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row a text, a column a query: similarities in single precision, and the part of the terms without a column in double."""
    score = _columns(asked, n, row, code, w, np.float32) @ asked.single.T
    many = asked.start[code + 1] - asked.start[code]
    has = many > 0
    row, code, w, many = row[has], code[has], w[has], many[has]
    rest = np.zeros((n, asked.n))  # a text's row stays in the cache while its products are added
    for part in np.split(np.arange(len(code)), np.searchsorted(np.cumsum(many), np.arange(STEP, many.sum(), STEP))):
        each = many[part]
        j = np.repeat(asked.start[code[part]] - np.append(0, np.cumsum(each)[:-1])[: len(each)], each) + np.arange(each.sum())
        np.add.at(rest.ravel(), np.repeat(row[part], each) * asked.n + asked.rows[j], asked.w[j] * np.repeat(w[part], each))
    score += rest
    return score, rest


def _near(asked: _Asked, texts: _Texts, group: int, idf: np.ndarray, most: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, number of the text, part in double) of all that may be among the ``most`` nearest, which single precision leaves open."""
    floor, found, size = np.full(asked.n, LEAST - SLACK), [], 0

    def thinned():
        q, t, s, rest = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((-s, q))
        q, t, s, rest = q[by], t[by], s[by], rest[by]
        last = np.arange(len(q)) - np.searchsorted(q, q) == most - 1
        floor[q[last]] = np.maximum(floor[q[last]], s[last] - SLACK)
        good = s >= floor[q]
        return q[good], t[good], s[good], rest[good]

    for first, batch in texts.read(group, rows, ["step", "tf"]):
        score, rest = _scores(asked, len(batch), *_unpacked(batch, idf))
        if not found and len(batch) >= most:
            np.maximum(floor, np.partition(np.ascontiguousarray(score.T), len(batch) - most, axis=1)[:, len(batch) - most] - SLACK, out=floor)
        at = np.flatnonzero(score >= floor.astype(np.float32))
        t, q = np.divmod(at, asked.n)
        found.append((q.astype(np.int32), first + t, score.ravel()[at], rest.ravel()[at]))
        if sum(len(f[0]) for f in found) > 1.25 * size:
            found = [thinned()]
            size = len(found[0][0])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
    q, t, _, rest = thinned()
    return q, t, rest


def _pool(asked: _Asked, own: pa.Table, texts: _Texts, group: int, idf: np.ndarray, most: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(query, number of the text, similarity, its key and mark): of the ``most`` nearest those the guards let pass, by query from the nearest."""
    q, t, rest = _near(asked, texts, group, idf, most, rows)
    by = np.argsort(t, kind="stable")
    q, t, rest = q[by], t[by], rest[by]
    exact, info, wanted = np.empty(len(q)), [], np.unique(t)
    for some, batch in texts.chosen(group, rows, ["key", "day", "mark", "step", "tf"], wanted):
        dense = _columns(asked, len(batch), *_unpacked(batch, idf), np.float64)
        a, b = np.searchsorted(t, some[0]), np.searchsorted(t, some[-1], "right")
        for i in range(a, b, 256):  # so many rows stay in the cache
            j = slice(i, min(i + 256, b))
            exact[j] = np.einsum("ij,ij->i", asked.dense[q[j]], dense[np.searchsorted(some, t[j])])
        info.append(batch.select(["key", "day", "mark"]))
    exact = np.round(exact + rest, 9)
    good = exact >= LEAST
    q, t, exact = q[good], t[good], exact[good]
    if not len(q):
        return q, t, exact, pa.table({"key": pa.array([], pa.string()), "mark": pa.array([], pa.string())})
    about = pa.Table.from_batches(info).take(pa.array(np.searchsorted(wanted, t))).combine_chunks()
    order = pc.sort_indices(pa.table({"q": q, "s": exact, "key": about["key"]}), [("q", "ascending"), ("s", "descending"), ("key", "ascending")], null_placement="at_start").to_numpy()
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < most]
    q, t, exact, about = q[order], t[order], exact[order], about.take(pa.array(order))
    mine = own.select(["key", "day", "mark"]).take(pa.array(q))
    passed = pc.and_(pc.and_(pc.not_equal(about["key"], mine["key"]), pc.less(about["day"], mine["day"])), pc.not_equal(about["mark"], mine["mark"]))
    passed = pc.fill_null(passed, False)
    keep = passed.to_numpy()
    return q[keep], t[keep], exact[keep], about.filter(passed).select(["key", "mark"])


def _walked(n: int, pool: tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table], texts: _Texts, group: int, idf: np.ndarray, k: int, rows: int) -> list[tuple[int, str, float, int]]:
    """(query, neighbour, similarity, rank): down the pool, not the same event as one taken before."""
    q, t, s, about = pool
    key, mark = about["key"].to_pylist(), about["mark"].to_pylist()
    at, end = np.searchsorted(q, np.arange(n)), np.searchsorted(q, np.arange(n), "right")
    kept, marks, out = [[] for _ in range(n)], [set() for _ in range(n)], []
    while (open_ := [i for i in np.flatnonzero(at < end).tolist() if len(kept[i]) < k]):
        # the first few settle nearly all queries; the others go on down the pool
        until = np.minimum(end, at + FIRST) if (end - at)[open_].sum() > n * FIRST else end
        vectors = {}
        for some, batch in texts.chosen(group, rows, ["step", "tf"], np.unique(np.concatenate([t[at[i] : until[i]] for i in open_]))):
            row, code, w = _unpacked(batch, idf)
            cut, code = np.searchsorted(row, np.arange(len(some) + 1)), code.astype(np.int32)
            vectors |= {i: (code[a:b], w[a:b]) for i, a, b in zip(some.tolist(), cut[:-1], cut[1:])}
        for i in open_:
            for j in range(at[i], until[i]):
                if mark[j] in marks[i]:
                    continue
                own = vectors[int(t[j])]
                if any(_product(own, other) >= SAME_EVENT for other in kept[i]):
                    continue
                kept[i].append(own)
                marks[i].add(mark[j])
                out.append((i, key[j], float(s[j]), len(kept[i])))
                if len(kept[i]) == k:
                    break
        at = until
    return out


def similar(corpus: DataFrame, queries: DataFrame, group: str, key: str, day: str, text: str, mark: Column, k: int, least_df: int = 2) -> DataFrame:
    """(query, neighbour, similarity, rank): at most ``k`` earlier texts of the query's group.

    Of the ``8 k`` most similar (ties by id, similarities to nine digits) the walk takes, from the top: not the query itself,
    strictly earlier, not the same event as the query or as one taken before (equal ``mark``, or similarity to it of 0.90 and
    more), and stops below 0.10. Weights come from the corpus only. Null texts have no terms; queries of an unknown group find
    nothing. Every query meets every text of its group, in blocks: terms never become rows, nor do pairs. The corpus is stored as
    vectors; a task takes its queries in blocks of 8,192 through the whole of their group and answers them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = corpus.sparkSession

    def prepared(df):
        when = {DateType(): F.unix_date, TimestampType(): F.unix_micros}.get(df.schema[day].dataType, lambda c: c)
        return df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("key"), when(F.col(day)).alias("day"), mark.cast("string").alias("mark"), hashed(F.col(text)).alias("words"))

    texts = prepared(corpus)
    shared = spark.sparkContext.broadcast(_known(texts, least_df))
    numbers = {g: i for i, g in enumerate(sorted(shared.value))}
    stored = _Texts(_store(texts, shared, numbers, POOL * k))
    if queries.rdd.getNumPartitions() < default_tasks(spark):
        queries = queries.repartition(default_tasks(spark), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = shared.value, defaultdict(list), defaultdict(int)

        def answers(g, own):
            asked, idf = _Asked(own["words"].combine_chunks(), known[g]), known[g][1]
            rows = max(64, min(8192, CELLS // asked.n))
            pool = _pool(asked, own, stored, numbers[g], idf, POOL * k, rows)
            out, names = _walked(asked.n, pool, stored, numbers[g], idf, k, rows), own["key"].to_pylist()
            columns = [[names[r[0]] for r in out], *([r[j] for r in out] for j in (1, 2, 3))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int32()))], names=["query", "neighbour", "similarity", "rank"])

        for batch in batches:
            for g in pc.unique(batch["g"]).to_pylist():
                if g not in known:
                    continue
                own = batch.filter(pc.equal(batch["g"], g))
                held[g].append(own)
                size[g] += len(own)
                if size[g] >= SLICE:
                    own = pa.Table.from_batches(held[g]).combine_chunks()
                    whole = len(own) - len(own) % SLICE
                    for at in range(0, whole, SLICE):
                        yield answers(g, own.slice(at, SLICE).combine_chunks())
                    held[g], size[g] = own.slice(whole).to_batches(), len(own) - whole
        for g in [*held]:
            if size[g]:
                yield answers(g, pa.Table.from_batches(held[g]).combine_chunks())

    return _written(prepared(queries).mapInArrow(run, "query string, neighbour string, similarity double, rank int"))
