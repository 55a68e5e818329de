"""Session defaults, table access and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's settings hold."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Have Spark send this package to the Python workers, which need not find it on their own path. Once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone.zip"  # read by the driver only, which serves it
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. Columns are pruned and filters pushed by Catalyst, so callers select what they need."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names. A private one only in local mode; elsewhere its absence raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not is_local(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernstone-"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all."""
    return master == "local" or master.startswith("local[")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder: the result outlives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def default_tasks(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for; the unit in which loads are balanced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
