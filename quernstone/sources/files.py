"""Files: gzipped JSON lines and zstd Parquet."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Timestamps keep their microseconds.
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted, nulls kept, gzipped. Tasks write files of their own."""
    ordered = df.select(*sorted(df.columns))
    ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIMES}).alias("value")).write.option("compression", "gzip").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows under ``schema``; blank lines are skipped, a line that isn't a JSON object of it ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").options(**_TIMES).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Zstd Parquet; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.option("compression", "zstd").parquet(path)


#: Rows that a sample file holds at most; it is written by the driver.
MOST_SAMPLED = 50_000


def write_sample(df: DataFrame, key: str, path: str) -> int:
    """A small sample as one gzipped file of JSON lines, by ``key`` as a number; returns its rows.

    The same rows give the same bytes: keys are sorted and the file's time is left out. More than ``MOST_SAMPLED`` rows raise.
    """
    rows = df.orderBy(F.col(key).cast("decimal(38, 0)"), key).limit(MOST_SAMPLED + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIMES}).alias("line")).collect()
    if len(rows) > MOST_SAMPLED:
        raise ValueError("too many rows for a sample file")
    lines = [json.dumps(json.loads(r["line"]), ensure_ascii=False, sort_keys=True) for r in rows]
    Path(path).write_bytes(gzip.compress("".join(f"{x}\n" for x in lines).encode(), mtime=0))
    return len(rows)
