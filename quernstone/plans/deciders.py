"""The reference's fitted deciders: logistic regressions on shape, intake columns and texts, and on texts with respondents' names masked."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from quernstone.functions.expressions import redactions
from quernstone.functions.vocabulary import EVAL_SPLITS
from quernstone.operators import bootstrap as B, metrics as M, regression as G
from quernstone.operators.masking import mask
from quernstone.plans import evaluation as E
from quernstone.plans.ingest import cases, scratch
from quernstone.plans.session import checkpointed
from quernstone.plans.textual import name_words

#: The reference's intake columns, company last, so that the codes of the others are the first ones.
CATEGORICAL = ["canonical_product", "sub_product", "issue", "sub_issue", "submitted_via", "tags", "state", "company"]
MODELS = ["shape", "company_only", "categorical_no_company", "categorical", "narrative", "categorical_plus_narrative"]
#: Least number of texts, most terms, whether accents fall away: of the narrative models, and of the two that measure name leaks.
NARRATIVE, LEAK = (5, 300_000, True), (3, 200_000, False)
#: (baseline, candidate) of the reference's paired comparisons.
COMPARISONS = [("shape", "narrative"), ("company_only", "narrative"), ("categorical", "narrative"), ("categorical", "categorical_plus_narrative"), ("categorical_no_company", "categorical")]
#: Distinct values of intake columns that are broadcast at most.
MOST_VALUES = 1_000_000

#: Bits of a term's number that tell rows apart while terms are counted; the other 52 are the term's.
ROW_BITS = 12

_TOKEN = re.compile(r"\b\w\w+\b")


def words(text: str, plain: bool) -> list[str]:
    text = text.lower()
    if plain and not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _TOKEN.findall(text)


def terms(text: str, plain: bool) -> list[str]:
    """Words of two and more characters and neighbouring two, in lower case; ``plain``: without accents."""
    w = words(text, plain)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


class _Numbers(dict):
    """64-bit numbers of words, each made once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = n = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return n


def numbered(texts: list[str | None], plain: bool, known: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all terms of the texts, words before pairs. Numbers end in ROW_BITS zeros."""
    flat, many = [], []
    for t in texts:
        own = words(t or "", plain)
        flat += map(known.__getitem__, own)
        many.append(len(own))
    one, row = np.array(flat, np.uint64), np.repeat(np.arange(len(texts)), many)
    beside = row[1:] == row[:-1]
    a, b = one[:-1][beside], one[1:][beside]
    two = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)  # order counts
    two = (two ^ (two >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    number = np.concatenate([one, two ^ (two >> np.uint64(32))])
    return np.concatenate([row, row[1:][beside]]), number >> np.uint64(ROW_BITS) << np.uint64(ROW_BITS)


def frequent(train: DataFrame, text: str, least: int, most: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, most frequent first, and idf of the terms that ``vocabulary`` has."""

    def counted(parts):
        h, tf, df = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        return h[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in (tf, df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = _Numbers(), []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in parts[0]], names=["h", "tf", "df"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1 << ROW_BITS):
                row, h = numbered(whole.column(0).slice(at, 1 << ROW_BITS).to_pylist(), plain, known)
                key = np.sort(h | row.astype(np.uint64))
                term = key >> np.uint64(ROW_BITS)
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
                new = np.append(True, key[1:] != key[:-1])[: len(key)].astype(np.int64)
                parts.append((term[first], np.diff(np.append(first, len(term))), np.add.reduceat(new, first) if len(first) else new))
                if len(parts) > 8:
                    parts = [counted(parts)]
                    if len(parts[0][0]) > 4_000_000:
                        yield out()
                        parts = []
        if parts:
            parts = [counted(parts)]
            yield out()

    n = train.count()
    found = train.select(text).mapInArrow(run, "h bigint, tf bigint, df bigint").groupBy("h").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = _stored(found.where(F.col("df") >= least))
    top = kept.orderBy(F.desc("tf"), "h").limit(most + 1).toArrow()
    if len(top) > most:
        last, beyond = top["tf"][most - 1].as_py(), top["tf"][most].as_py()
        top = top.slice(0, most)
        if last == beyond:  # the terms with as many as the last are taken by name
            above = top.filter(pc.greater(top["tf"], last))
            tied = kept.where(F.col("tf") == last)
            top = pa.concat_tables([above, _named(train, text, tied, plain).orderBy("term").limit(most - len(above)).select("h", "tf", "df").toArrow().cast(above.schema)])
    return top["h"].to_numpy().view(np.uint64), np.log((1 + n) / (1 + top["df"].to_numpy())) + 1


def _named(train: DataFrame, text: str, some: DataFrame, plain: bool) -> DataFrame:
    """Rows of numbered terms with the ``term`` itself."""
    numbers = train.sparkSession.sparkContext.broadcast(np.sort(some.select("h").toArrow()["h"].to_numpy().view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, seen = _Numbers(), numbers.value, set()
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                h = numbered([t], plain, known)[1] >> np.uint64(ROW_BITS)
                at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                own = terms(t or "", plain)
                for i in np.flatnonzero(wanted[at] == h) if len(wanted) else ():
                    if at[i] not in seen:
                        seen.add(at[i])
                        found.append((int(h[i]), own[i]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["h", "term"])

    return train.select(text).mapInArrow(run, "h bigint, term string").distinct().join(some, "h")


def vocabulary(train: DataFrame, text: str, least: int, most: int, plain: bool) -> dict[str, tuple[int, float]]:
    """term -> (index, idf). Of the terms in at least ``least`` texts the ``most`` frequent ones, ties by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array([*tf]), pa.array([*tf.values()], pa.int64()), pa.array([df[t] for t in tf], pa.int64())], names=["term", "tf", "df"])

        tf, df = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = terms(t or "", plain)
                tf.update(own)
                df.update(set(own))
                if len(tf) > 1_000_000:
                    yield out()
                    tf, df = Counter(), Counter()
        if tf:
            yield out()

    n = train.count()
    found = train.select(text).mapInArrow(run, "term string, tf bigint, df bigint").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = found.where(F.col("df") >= least).orderBy(F.desc("tf"), "term").limit(most).toArrow()
    idf = np.log((1 + n) / (1 + kept["df"].to_numpy())) + 1
    return {t: (i, float(w)) for i, (t, w) in enumerate(zip(kept["term"].to_pylist(), idf))}


def weights(text: str, known: dict[str, tuple[int, float]], plain: bool) -> tuple[list[int], list[float]]:
    """Indices ascending, and (1 + ln tf) * idf over the text's length."""
    hit = sorted((known[t][0], (1 + log(k)) * known[t][1]) for t, k in Counter(terms(text, plain)).items() if t in known)
    norm = sum(w * w for _, w in hit) ** 0.5
    return [i for i, _ in hit], [w / norm for _, w in hit]


def value_codes(train: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """(column, value) -> code, as onehot_vocab has it: values under five in one bucket a column, the columns' codes one after another."""
    counts = train.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column_name", "value")).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rows = counts.limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values of intake columns")
    codes: dict[tuple[str, str], int] = {}
    start = 0
    for c in columns:
        own = {r["value"]: r["n"] for r in rows if r["column_name"] == c}
        merged = Counter()
        for v, n in own.items():
            merged[v if n >= 5 else "(rare)"] += n
        at = {v: start + i for i, v in enumerate(sorted(merged, key=lambda v: (-merged[v], v)))}
        codes |= {(c, v): at[v if n >= 5 else "(rare)"] for v, n in own.items()}
        start += len(at)
    return codes


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and evaluation cases with an outcome: intake columns, text and shape."""
    chars, red = F.length("narrative"), redactions(F.col("narrative"))
    shape = F.array(F.log1p(chars), F.log1p(red), red / F.greatest(chars, F.lit(1)))
    named = [F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in CATEGORICAL]
    rows = cases(spark, sf_dir).where((F.col("label") != "excluded") & F.col("split").isin("train", *EVAL_SPLITS))
    return rows.select("complaint_id", "split", F.when(F.col("label") == "needed_human", 1).otherwise(0).alias("y"), *named, "narrative", F.transform(shape, lambda x: F.coalesce(x, F.lit(0.0)).cast("double")).alias("shape"))


def encoded(rows: DataFrame, key: list[str], inputs: list[str], names: list[str], of: Callable[[dict], list[tuple[int, list[int], list[float]]]]) -> DataFrame:
    """``key`` columns and a sparse vector for each of ``names``; ``of`` gives a row's sizes, indices and values."""
    from pyspark.ml.linalg import VectorUDT

    schema = StructType([*[rows.schema[c] for c in key], *[StructField(f, VectorUDT()) for f in names]])
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                each = zip(*[of(r) for r in batch.select(inputs).to_pylist()])
                vectors = [pa.array([{"type": 0, "size": n, "indices": i, "values": v} for n, i, v in column], kind) for column in each]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in key], *vectors], names=[*key, *names])

    return rows.select(*dict.fromkeys([*key, *inputs])).mapInArrow(run, schema)


def _stored(df: DataFrame) -> DataFrame:
    """Vectors in the shared folder as Parquet, which takes a fraction of a checkpoint's space."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fitted(rows: DataFrame, names: list[str]) -> DataFrame:
    """(complaint_id, split, y) of evaluation cases and P(y = 1) of a regression on each vector column, fitted over all train rows.

    Half the squared weights are added to the summed loss (C = 1); the intercept isn't penalised.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    train = rows.where("split = 'train'").withColumn("y", F.col("y").cast("double"))
    n = max(train.count(), 1)

    def fit(name):
        return LogisticRegression(featuresCol=name, labelCol="y", rawPredictionCol=f"raw_{name}", probabilityCol=f"probability_{name}", predictionCol=f"prediction_{name}", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(train)

    with ThreadPoolExecutor(3) as pool:  # an iteration is a short job, so several models share the cores
        models = list(pool.map(fit, names))
    scored = rows.where(F.col("split").isin(EVAL_SPLITS))
    for model in models:
        scored = model.transform(scored)
    return scored.select("complaint_id", "split", "y", *[F.round(vector_to_array(f"probability_{m}")[1], 6).alias(f"p_{m}") for m in names])


def blocks(rows: DataFrame, codes: dict[tuple[str, str], int], known: tuple[np.ndarray, np.ndarray], plain: bool) -> DataFrame:
    """``frame`` rows as blocks for ``regression``: key, ids, splits and data."""
    order = np.argsort(known[0])
    shared = rows.sparkSession.sparkContext.broadcast((codes, known[0][order], order, known[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sorted_, place, idf = shared.value
        none, numbers = max(codes.values(), default=-1) + 1, _Numbers()
        for whole in batches:
            for at in range(0, whole.num_rows, G.ROWS):
                batch = whole.slice(at, G.ROWS)
                coded = []
                for c in CATEGORICAL:  # values that train hasn't are none
                    column = batch[c].dictionary_encode()
                    coded.append(np.array([codes.get((c, v), none) for v in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()])
                row, h = numbered(batch["narrative"].to_pylist(), plain, numbers)
                h >>= np.uint64(ROW_BITS)
                near = np.minimum(np.searchsorted(sorted_, h), max(len(sorted_) - 1, 0))
                hit = sorted_[near] == h if len(sorted_) else np.zeros(len(h), bool)
                both = np.sort(row[hit] * len(place) + place[near[hit]])
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
                row, index = np.divmod(both[first], max(len(place), 1))
                tf = np.diff(np.append(first, len(both)))
                w = (1 + np.log(tf)) * idf[index]
                length = np.sqrt(np.bincount(row, w * w, batch.num_rows))
                data = G.packed(batch["y"].to_numpy(), batch["shape"].flatten().to_numpy().reshape(-1, 3), np.stack(coded, 1), row, index, tf, np.divide(1, length, out=np.zeros(len(length)), where=length > 0))
                key = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_pydict({"key": [key], "ids": [batch["complaint_id"].to_pylist()], "splits": [batch["split"].to_pylist()], "data": [data]})

    return rows.select("complaint_id", "split", "y", *CATEGORICAL, "narrative", "shape").mapInArrow(run, "key bigint, ids array<string>, splits array<string>, data binary")


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(needed human) of evaluation cases by the reference's six regressions, a column each."""
    rows = frame(spark, sf_dir)
    train = rows.where("split = 'train'")
    codes = value_codes(train, CATEGORICAL)
    least, most, plain = NARRATIVE
    known = frequent(train, "narrative", least, most, plain)
    others, every = max([c for (name, _), c in codes.items() if name != "company"], default=-1) + 1, max(codes.values(), default=-1) + 1
    layout = G.Layout(3, every, known[1])
    shape, company, some, coded, text = layout.columns("shape"), layout.columns("codes", slice(others, None)), layout.columns("codes", slice(0, others)), layout.columns("codes"), layout.columns("words")
    models = [(("shape",), shape), (("codes",), company), (("codes",), some), (("codes",), coded), (("words",), text), (("codes", "words"), np.append(coded, text))]
    found = G.fit(_stored(blocks(train, codes, known, plain)), layout, models)
    scored = _stored(blocks(rows.where(F.col("split").isin(EVAL_SPLITS)), codes, known, plain))
    return G.chances(scored, layout, models, found, [f"p_{m}" for m in MODELS])


def name_leak_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(needed human) of validation cases by regressions on the text as published, and with all respondents' names masked."""
    rows = frame(spark, sf_dir).where("split in ('train', 'validation')").select("complaint_id", "split", "y", "narrative", F.lower("narrative").alias("masked"))
    rows = checkpointed(mask(rows, "complaint_id", "masked", name_words(spark, sf_dir).select("word"), "word", "COMPANYNAME"))
    train = rows.where("split = 'train'")
    least, most, plain = LEAK
    known = [vocabulary(train, text, least, most, plain) for text in ("narrative", "masked")]
    shared = spark.sparkContext.broadcast(known)

    def of(r):
        return [(len(k), *weights(r[text] or "", k, plain)) for k, text in zip(shared.value, ("narrative", "masked"))]

    names = ["published", "masked_names"]
    done = fitted(_stored(encoded(rows, ["complaint_id", "split", "y"], ["narrative", "masked"], names, of)), names)
    return done.withColumnRenamed("p_masked_names", "p_masked")


def name_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, share decided at a budget of 0.05 and calibration error with and without names in the text."""
    rows = checkpointed(name_leak_scores(spark, sf_dir))
    n, out = rows.count(), []
    for m in ("published", "masked"):
        own = rows.select("y", F.col(f"p_{m}").alias("p"), F.round(1 - F.col(f"p_{m}"), 6).alias("c"))
        best = M.best_at(M.frontier(own), [0.05], n).select(F.coalesce("arr", F.lit(0.0)).alias("arr"))
        one = M.ranking(own, "p", "y").crossJoin(best).crossJoin(M.ece(own))  # one row each
        out.append(one.select(F.lit(m).alias("narrative"), *[F.round(c, 6).alias(c) for c in ("auc", "arr", "ece")]))
    return out[0].unionByName(out[1])


def score_table_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evaluation case, the confidence P(no relief) of the reference's seven deciders."""
    constant = E.majority(spark, sf_dir).select("complaint_id", F.col("c").alias("c_majority_class"))
    scores = lr_scores(spark, sf_dir).select("complaint_id", "split", F.col("y").alias("needed_human"), *[F.round(1 - F.col(f"p_{m}"), 6).alias(f"c_{m}") for m in MODELS])
    return scores.join(constant, "complaint_id")


def paired_auc_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in area of the reference's five comparisons on either evaluation split, with 95 % intervals over paired draws."""
    rows = checkpointed(lr_scores(spark, sf_dir))
    pairs = [(f"p_{a}", f"p_{b}") for a, b in COMPARISONS]
    drawn = [B.gains(rows.where(F.col("split") == s), "complaint_id", "y", pairs, E.FULL_DRAWS, E.SEED).withColumn("split", F.lit(s)) for s in EVAL_SPLITS]
    both = drawn[0].unionByName(drawn[1]).select("split", *[F.substring(c, 3, 99).alias(c) for c in ("base", "candidate")], "gain")
    return E._interval(both, ["split", "base", "candidate"], "gain")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lr_scores": lr_scores, "name_leak_scores": name_leak_scores, "name_leak": name_leak, "score_table_full": score_table_full, "paired_auc_models": paired_auc_models}
ORACLES: dict[str, str] = {}
