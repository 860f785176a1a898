"""The structure of all files that a stream has seen, by project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.schemas import FILE_ANALYSIS
from corpuslens.sources.levels import Levels, Segment

KEYS = ["project", "path"]
SLOTS = 64
STORED = f"{FILE_ANALYSIS}, batch long, slot int"


class StructureStore(Levels):
    """Rows of an analysis, the newest per file, in folders by a hash of the project.

    A batch adds its files as one segment and reads the segments' folders of its own
    projects only. Segments are merged in levels, so what a batch reads does not grow
    with the batches before it.
    """

    kind = "structure"

    def __init__(self, spark: SparkSession, folder: str, fan_out: int = 4):
        super().__init__(spark, folder, fan_out, SLOTS)

    def _slot(self):
        return F.pmod(F.xxhash64("project"), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> str:
        """Ranged by folder and path: few files to a folder, and a large project in several."""
        name = self.new_name()
        ranged = rows.withColumn("slot", self._slot()).repartitionByRange("slot", *KEYS)
        ranged.write.partitionBy("slot").parquet(self.place(name))
        return name

    def _rows(self, segments: list[Segment]) -> DataFrame:
        # Each segment is a folder of its own, whose subfolders Spark prunes.
        return reduce(DataFrame.unionByName, [self.spark.read.schema(STORED).parquet(self.place(s.segment)) for s in segments])

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*KEYS, "batch"], "left_semi")

    def merged(self, segments: list[Segment]) -> DataFrame:
        return self._newest(self._rows(segments)).drop("slot")

    def add(self, analysis: DataFrame, batch: int) -> None:
        """A batch's files, one row each; a batch that is there already is left out."""
        self.add_rows(analysis.withColumn("batch", F.lit(batch).cast("long")), f"{batch:010d}")

    def of(self, projects: DataFrame, upto: int) -> DataFrame:
        """The newest rows, up to a batch, of all files of some projects."""
        if not self.segments:
            return self.spark.createDataFrame([], FILE_ANALYSIS)
        wanted = projects.select("project").distinct()
        # As many as there are folders.
        slots = [r["slot"] for r in wanted.select(self._slot().alias("slot")).distinct().collect()]
        rows = self._rows(self.segments).where(F.col("slot").isin(slots) & (F.col("batch") <= upto))
        return self._newest(rows.join(wanted, "project", "left_semi")).drop("batch", "slot")
