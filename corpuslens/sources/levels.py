"""Keyed stores in levels: segments that are added, merged, and listed in one place.

Each addition is a segment of level 0. A level that has ``fan_out`` segments is
merged into one of the next level, so there are as many segments as the logarithm of
the additions. What holds at any time is the newest version of a small list, which is
replaced as a whole; segments it does not name count for nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpuslens.operators.storage import children, remove_folder

LIST = "segment string, level int, buckets int, added array<string>"


@dataclass(frozen=True)
class Segment:
    segment: str
    level: int
    buckets: int
    added: tuple[str, ...]


class Levels:
    """A store in ``folder``; one job at a time may write to it. Kinds of store say how segments are written and merged."""

    kind = "segment"

    def __init__(self, spark: SparkSession, folder: str, fan_out: int, buckets: int):
        self.spark, self.folder, self.fan_out = spark, folder, fan_out
        versions = children(spark, f"{folder}/list", holding="_SUCCESS")
        self.version = int(versions[-1][2:]) if versions else 0
        stored = spark.read.schema(LIST).parquet(f"{folder}/list/{versions[-1]}").collect() if versions else []
        self.segments = [Segment(r["segment"], r["level"], r["buckets"], tuple(r["added"])) for r in stored]
        self.buckets = self.segments[0].buckets if stored else buckets

    def added(self) -> set[str]:
        """Names of all additions that count."""
        return {name for s in self.segments for name in s.added}

    def place(self, segment: str) -> str:
        return f"{self.folder}/segments/{segment}"

    def new_name(self) -> str:
        return f"{self.kind}_{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> str:
        raise NotImplementedError

    def merged(self, segments: list[Segment]) -> DataFrame:
        raise NotImplementedError

    def forget(self, segment: str) -> None:
        """Called before a merged segment's files go."""

    def add_rows(self, rows: DataFrame, name: str) -> None:
        """Adds rows under a name; a name that is there already is left out."""
        if name in self.added():
            return
        made = Segment(self.write(rows), 0, self.buckets, (name,))
        segments, merged, level = [made, *self.segments], [], 0
        while len(full := [s for s in segments if s.level == level]) >= self.fan_out:
            names = tuple(n for s in full for n in s.added)
            made = Segment(self.write(self.merged(full)), level + 1, self.buckets, names)
            segments = [made, *(s for s in segments if s.level != level)]
            merged += full
            level += 1
        self._commit(segments)
        for old in merged:
            self.forget(old.segment)
            remove_folder(self.spark, self.place(old.segment))

    def _commit(self, segments: list[Segment]) -> None:
        before, self.version, self.segments = self.version, self.version + 1, segments
        rows = [(s.segment, s.level, s.buckets, list(s.added)) for s in segments]
        listed = self.spark.createDataFrame(rows, LIST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.folder}/list/v={self.version:010d}")
        remove_folder(self.spark, f"{self.folder}/list/v={before:010d}")
