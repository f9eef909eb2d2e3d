"""What every job needs from the session: the package on the workers, and a shared place for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query that ended are deleted at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a cluster installs it or passes it by --py-files)."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a local master; on a cluster executors could not see it, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a shared folder")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The lineage ends there: a lost executor costs a re-read and never a recomputation, and the shuffle files of the write
    go with its end. The path is kept on the returned frame as ``.cut_path`` so that a loop can drop what it no longer needs.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; an enclosing :func:`scratch` block removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _open_blocks:
        made.append(path)
    return path


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; without this they stay until the driver happens to collect garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


_open_blocks: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Every file of :func:`cut` and :func:`new_path` made inside goes when the block ends; what is read from them must be written by then."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`cut`; nothing may read those frames afterwards."""
    for df in frames:
        remove(df.sparkSession, df.cut_path)
