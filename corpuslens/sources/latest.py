"""The latest result of each file, as a keyed table with levels.

A finished run adds one segment: a narrow row for each of its files, in buckets of
the file's key. A run asks each segment for its files by a bucketed join, so neither
a segment nor any answer text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pinned
from corpuslens.functions.review_text import ERROR_PREFIX
from corpuslens.sources.levels import Levels, Segment

KEYS = ["project", "path"]
# ``ai_analysis`` holds the first characters only: enough to tell an error.
ROWS = "project string, path string, run_ts timestamp, run_id string, ai_status string, ai_analysis string, file_hash string"
REST = ["run_ts", "run_id", "ai_status", "ai_analysis", "file_hash"]


class LatestResults(Levels):
    """The table under ``folder``.

    While it is open its segments are tables of the session's catalog, as buckets
    are only known to tables; ``close`` takes them out again.
    """

    kind = "latest"

    def __init__(self, spark: SparkSession, folder: str, fan_out: int = 4):
        super().__init__(spark, f"{folder}/latest", fan_out, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.tables: set[str] = set()

    def write(self, rows: DataFrame) -> str:
        """A segment of the newest row per key; the aggregate works inside the buckets' own partitions."""
        name = self.new_name()
        dealt = rows.repartition(self.buckets, *KEYS)
        (
            dealt.groupBy(*KEYS).agg(F.max(F.struct(*REST)).alias("newest")).select(*KEYS, "newest.*")
            .write.bucketBy(self.buckets, *KEYS)
            .sortBy(*KEYS)
            .option("path", self.place(name))
            .saveAsTable(name)
        )
        self.tables.add(name)
        return name

    def merged(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*[self.place(s.segment) for s in segments])

    def _table(self, segment: Segment) -> DataFrame:
        if segment.segment not in self.tables:
            keys = ", ".join(KEYS)
            self.spark.sql(
                f"CREATE TABLE {segment.segment} ({ROWS}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {segment.buckets} BUCKETS LOCATION '{self.place(segment.segment)}'"
            )
            self.tables.add(segment.segment)
        return self.spark.table(segment.segment)

    def add(self, results: DataFrame, run_id: str) -> None:
        """Adds the results of a finished run (rows of a review snapshot); a known run is left out."""
        start = F.left("ai_analysis", F.lit(len(ERROR_PREFIX))).alias("ai_analysis")
        self.add_rows(results.select(*KEYS, "run_ts", "run_id", "ai_status", start, "file_hash"), run_id)

    def join(self, files: DataFrame) -> DataFrame:
        """Adds ``prev_found``, ``prev_status``, ``prev_analysis`` (its start), ``prev_hash`` and ``prev_run`` to each file."""
        names, columns = [], files.columns
        # A project that Catalyst knows to be constant would leave the join, and with it the buckets.
        files = pinned(files, project=F.col("project"))
        for i, segment in enumerate(self.segments):
            names.append(f"_newest{i}")
            rows = self._table(segment).select(
                *KEYS, F.struct(*REST).alias(names[-1])
            )
            files = files.join(rows, KEYS, "left")
        if not names:
            newest = F.lit(None).cast("struct<run_ts:timestamp,run_id:string,ai_status:string,ai_analysis:string,file_hash:string>")
        else:
            newest = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        return files.withColumn("_newest", newest).select(
            *columns,
            F.col("_newest").isNotNull().alias("prev_found"),
            F.col("_newest.ai_status").alias("prev_status"),
            F.col("_newest.ai_analysis").alias("prev_analysis"),
            F.col("_newest.file_hash").alias("prev_hash"),
            F.col("_newest.run_id").alias("prev_run"),
        )

    def forget(self, segment: str) -> None:
        if segment in self.tables:
            self.tables.discard(segment)
            self.spark.sql(f"DROP TABLE IF EXISTS {segment}")

    def close(self) -> None:
        for segment in list(self.tables):
            self.forget(segment)
