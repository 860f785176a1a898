"""Reviews and counters that follow files as they arrive."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpuslens.operators.incremental import status_counts
from corpuslens.operators.storage import join_few, materialised, stages_dropped
from corpuslens.plans.batch import KEYS, ReviewOptions, review_run
from corpuslens.sources.files import TASKS_PER_CORE
from corpuslens.sources.structure_store import StructureStore


def _kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stream_incremental_review(
    files: DataFrame,
    folder: str,
    checkpoint: str,
    options: ReviewOptions | None = None,
    now: Callable[[], float] = time.time,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reviews each micro-batch of ``project, path, text, parse_error, mtime`` rows.

    The batch number is the run id, and a batch that is run again finds what it has
    finished, so every file has one result per batch it came in with. Files that a
    cooldown skipped, or whose review failed, come again with the next batch,
    unless a newer version of them has arrived. Reviewers see the structure of
    all files of a project that have arrived so far; a local reviewer, which sees no
    documents, leaves none stored. ``trigger`` holds the
    keyword arguments of the stream's trigger.

    Waiting files are kept in two folders used in turn: a batch reads the one and
    writes the other, so that running it again finds what it found before.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = StructureStore(spark, f"{folder}/structure")
        with stages_dropped(spark):
            waiting = _kept(spark, f"{folder}/waiting/{(batch_id - 1) % 2}", batch.schema)
            waiting = waiting.join(batch.select(*KEYS), KEYS, "left_anti")
            # Few large files of a drop would be as few tasks in all that follows.
            tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
            rows = materialised(batch.unionByName(waiting).repartition(tasks))

            def arrived(analysis: DataFrame) -> DataFrame:
                store.add(analysis, batch_id)
                return materialised(store.of(analysis, batch_id))

            results = review_run(rows, folder, f"batch-{batch_id:010d}", now(), options, context=arrived)
            again = results.filter(F.col("ai_status").isin("skipped", "error")).select(*KEYS)
            left = join_few(rows.filter(F.col("text").isNotNull()), materialised(again), KEYS, "left_semi")
            left.write.mode("overwrite").parquet(f"{folder}/waiting/{batch_id % 2}")

    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_status_totals(
    results: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keeps status counts per project up to date while results arrive.

    The counts are streaming state. A batch adds the totals it changed to those of
    the batch before, in one of two folders used in turn, so that old batches leave
    nothing and a batch can be run again.
    """
    totals = status_counts(results, ["project"])

    def store(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id).cast("long").alias("batch")
        changed = batch.select(*batch.columns, number)
        before = _kept(batch.sparkSession, f"{folder}/slot={(batch_id - 1) % 2}", changed.schema)
        same = before.join(batch.select("project"), "project", "left_anti").select(*batch.columns, number)
        changed.unionByName(same).write.mode("overwrite").parquet(f"{folder}/slot={batch_id % 2}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_totals(stored: DataFrame) -> DataFrame:
    """Totals of the newest batch."""
    newest = stored.agg(F.max("batch").alias("batch"))
    return stored.join(newest, "batch", "left_semi").drop("batch", "slot")
