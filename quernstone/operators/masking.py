"""Finding and masking words of a vocabulary in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words that are broadcast at most. Larger vocabularies are applied in slices, one after another.
SLICE_WORDS = 200_000


def mentions_own(text: Column, words: Column) -> Column:
    """Whether any of a row's own words stands in its text as a whole word (letters and digits of ASCII)."""
    tokens = F.split(F.lower(text), r"[^a-z0-9_]+")
    return F.arrays_overlap(tokens, words)


def mask(df: DataFrame, key: str, text: str, vocabulary: DataFrame, word: str, put: str) -> DataFrame:
    """``df`` with each whole word (run of ASCII letters, digits and underscores) of the vocabulary replaced by ``put``.

    Words are looked up in a set, so the time doesn't grow with the vocabulary. Null texts stay null; null and empty words are
    left out. A vocabulary of more than ``SLICE_WORDS`` words is applied slice by slice.
    """
    words = vocabulary.select(F.col(word).alias("w")).where("w <> ''").distinct()
    slices = max(1, -(-words.count() // SLICE_WORDS))
    numbered = words.withColumn("s", F.pmod(F.xxhash64("w"), F.lit(slices)))
    out = df
    for s in range(slices):
        shared = df.sparkSession.sparkContext.broadcast(frozenset(r["w"] for r in numbered.where(F.col("s") == s).select("w").collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import re

            token = re.compile(r"[A-Za-z0-9_]+")
            known = shared.value
            swap = lambda m: put if m.group() in known else m.group()
            for batch in batches:
                at = batch.schema.get_field_index(text)
                done = [None if t is None else token.sub(swap, t) for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, text, pa.array(done, pa.string()))

        out = out.mapInArrow(run, out.schema)
    return out
