"""Writers. A run's rows count only once its id is in the run table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import utc_stamp
from corpuslens.operators.analysis import document_start, file_record
from corpuslens.operators.incremental import status_counts
from corpuslens.operators.storage import children, materialised, qualified
from corpuslens.schemas import REVIEW_SNAPSHOT, RUN_STATE
from corpuslens.sources.files import open_store


def write_analysis_json(analysis: DataFrame, path: str) -> None:
    """One object per file and line, with fixed keys, in a folder per project.

    Rows are first ranged by project and path: a task writes the few projects of
    its range, and a large project is shared by several tasks. Short rows of many
    projects cost a file each, so the number of tasks does not go by their bytes.
    """
    # Written once: ranging samples its input, which must not parse all files again.
    records = materialised(analysis.select("project", "path", F.to_json(file_record()).alias("value")))
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(tasks, "project", "path").select("project", "value")
    ranged.write.mode("overwrite").partitionBy("project").text(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Analysis documents, one object per line; a piece names the place of its ``first`` file."""
    line = F.concat(
        document_start(), F.lit(',"first":'), F.col("first").cast("string"), F.lit(',"files":['), F.col("records"), F.lit("]}")
    )
    snapshot.select(line.alias("value")).write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str, key: str | None = None) -> None:
    """A file for each row of ``value``, all in one folder: a folder for each costs more than the file in it.

    With ``key`` the rows of one key are the pieces of one file, put together in
    order of ``part``. They stream into it, so no task holds a document. A file is
    whole or not there; a task that is run again writes the same files again.
    """
    if key is None:
        documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
        return
    spark = documents.sparkSession
    target = qualified(spark, path)
    store, top = open_store(target)
    if store.get_file_info(top).type != fs.FileType.NotFound:
        raise FileExistsError(f"{target} is there already")
    store.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = open_store(target)
        current, out, hidden = None, None, f"{folder}/_open-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                for name, value in zip(*(batch.column(c) for c in ("name", "value")), strict=True):
                    if name != current:
                        if out is not None:
                            out.close()
                            files.move(hidden, f"{folder}/{current}.json")
                        current, out = name, files.open_output_stream(hidden)
                    out.write(value.as_buffer() or b"")
            if out is not None:
                out.close()
                files.move(hidden, f"{folder}/{current}.json")
                out = None
        finally:
            if out is not None:
                if not out.closed:
                    out.close()
                if files.get_file_info(hidden).type == fs.FileType.File:
                    files.delete_file(hidden)
        yield from ()

    # Named by the key, whatever characters that has; a null key has a name of its own.
    pieces = documents.select(F.sha2(F.to_json(F.array(key)), 256).alias("name"), "part", "value")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = pieces.repartition(tasks, "name").sortWithinPartitions("name", "part")
    in_order.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_review_snapshot(
    results: DataFrame, folder: str, run_id: str, model: str, run_ts: Column
) -> None:
    """Results of one run, then the run's header row that makes them visible.

    Without a header, what an earlier try has left under the run id is replaced. A
    run that has its header is finished and is not written again.
    """
    if run_id in finished_runs(results.sparkSession, folder):
        raise ValueError(f"Run {run_id} is finished")
    rows = (
        results.withColumn("model", F.lit(model))
        .withColumn("run_ts", run_ts)
        .select("project", "path", "rule_based_issues", "ai_status", "ai_analysis", "file_hash", "model", "run_ts")
    )
    target = f"{folder}/results/run_id={run_id}"
    rows.write.mode("overwrite").parquet(target)
    written = rows.sparkSession.read.parquet(target)
    header = status_counts(written, ["project"]).select(
        "project",
        F.lit(model).alias("model"),
        utc_stamp(run_ts).alias("generated_at_utc"),
        F.struct("generated", "cached", "skipped", "errors").alias("stats"),
    )
    header.write.mode("overwrite").parquet(f"{folder}/runs/run_id={run_id}")


def finished_runs(spark: SparkSession, folder: str) -> list[str]:
    """Ids of the runs whose header is written, in order."""
    return [unquote(name.partition("=")[2]) for name in children(spark, f"{folder}/runs", holding="_SUCCESS")]


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "project string, model string, generated_at_utc string, "
        "stats struct<generated:bigint,cached:bigint,skipped:bigint,errors:bigint>, run_id string"
    ).parquet(f"{folder}/runs")


def read_review_snapshot(spark: SparkSession, folder: str, runs: list[str] | None = None) -> DataFrame:
    """Rows of finished runs, or of those named; the folders of other runs are not read."""
    finished = finished_runs(spark, folder)
    chosen = finished if runs is None else [r for r in finished if r in set(runs)]
    if not chosen:
        return spark.createDataFrame([], REVIEW_SNAPSHOT)
    rows = spark.read.schema(REVIEW_SNAPSHOT).parquet(f"{folder}/results")
    # The run id is a folder, so unfinished runs are not read.
    return rows.where(F.col("run_id").isin(chosen)).select(*[field.split()[0] for field in REVIEW_SNAPSHOT.split(", ")])


def report_view(results: DataFrame) -> DataFrame:
    """Results as JSON lines with the five fields of a report entry."""
    fields = ["path", "rule_based_issues", "ai_status", "ai_analysis", "file_hash"]
    return results.select("project", F.to_json(F.struct(*fields)).alias("result"))


def write_report(spark: SparkSession, folder: str, run_id: str, manifest: DataFrame, path: str) -> None:
    """A finished run as report documents: root, model, time, statistics and the results in manifest order.

    One folder per project under ``path``; its files, put together in order of their
    names, are one JSON document with a line to each result. Lines are ranged by
    project and place, so a large project is several files and no task holds it.
    ``manifest`` has ``project, path, pos``; results without a place are left out.
    """
    results = read_review_snapshot(spark, folder, [run_id])
    fields = ["path", "rule_based_issues", "ai_status", "ai_analysis", "file_hash"]
    entry = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lines = manifest.select("project", "path", "pos").join(results, ["project", "path"]).select("project", "pos", entry.alias("entry"))
    first = lines.groupBy("project").agg(F.min("pos").alias("first"))
    comma = F.when(F.col("pos") > F.col("first"), F.lit(",")).otherwise(F.lit(""))
    body = lines.join(first, "project").select("project", "pos", F.concat(comma, "entry").alias("value"))
    # One row per project.
    runs = read_runs(spark, folder).where(F.col("run_id") == run_id)
    head = F.regexp_replace(F.to_json(F.struct(F.col("project").alias("root"), "model", "generated_at_utc", "stats")), r"\}\z", "")
    edge = lambda place, value: runs.select("project", F.lit(place).cast("long").alias("pos"), value.alias("value"))
    whole = body.unionByName(edge(-(1 << 62), F.concat(head, F.lit(',"results":[')))).unionByName(edge(1 << 62, F.lit("]}")))
    ranged = whole.repartitionByRange("project", "pos").sortWithinPartitions("project", "pos")
    ranged.select("project", "value").write.partitionBy("project").text(path)


def save_run_state(starts: DataFrame, folder: str, run_id: str) -> None:
    """Stores the starts ``project, started_at`` (epoch seconds) of one run."""
    starts.select("project", "started_at").write.mode("overwrite").parquet(
        f"{folder}/run_id={run_id}"
    )


def load_run_state(spark: SparkSession, folder: str, besides: str = "") -> DataFrame:
    """Last run start per project; no rows where nothing usable is stored, corrupt files included."""
    try:
        stored = spark.read.schema(RUN_STATE).option("ignoreCorruptFiles", True).parquet(folder)
    except AnalysisException:
        stored = spark.createDataFrame([], RUN_STATE)
    return last_run_starts(stored.filter(F.col("run_id") != besides))


def last_run_starts(stored: DataFrame) -> DataFrame:
    return (
        stored.filter(F.col("started_at").isNotNull())
        .groupBy("project")
        .agg(F.max("started_at").alias("last_started_at"))
    )
