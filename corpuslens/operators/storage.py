"""Cutting lineage on shared storage, and joins that depend on a stored size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: a bare path is on the default file system, for Python tasks too."""
    files, path = _at(spark, folder)
    return files.makeQualified(path).toString()


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _at(spark, folder)
    files.delete(path, True)


def children(spark: SparkSession, folder: str, holding: str | None = None) -> list[str]:
    """Names in a folder, sorted; none where there is no folder. With ``holding`` only folders that hold such a file."""
    files, path = _at(spark, folder)
    if not files.exists(path):
        return []
    names = sorted(status.getPath().getName() for status in files.listStatus(path))
    return [n for n in names if holding is None or files.exists(_at(spark, f"{folder}/{n}/{holding}")[1])]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, with its scheme; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return qualified(spark, folder)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return qualified(spark, current)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpuslens-")
    spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder)


_open_stages: ContextVar[list[str] | None] = ContextVar("open_stages", default=None)


@contextmanager
def stages_dropped(spark: SparkSession) -> Iterator[None]:
    """Stages written inside are removed at its end; no frame that reads them may be handed out."""
    folders: list[str] = []
    before = _open_stages.set(folders)
    try:
        yield
    finally:
        _open_stages.reset(before)
        for folder in folders:
            remove_folder(spark, folder)


def materialised(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that every reader sees the same ones.

    Lost executors cost no more than the step that was running, later steps read
    only the columns they need, and Catalyst knows the real size.
    """
    folder = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    stages = _open_stages.get()
    if stages is not None:
        stages.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


BROADCAST_ROWS = 100_000


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins a narrow, stored side that is often small.

    It is counted first. Up to 100,000 rows it is broadcast, so that the wide
    side stays where it is; beyond that both sides are shuffled.
    """
    small = few.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(few) if small else few, keys, how)
