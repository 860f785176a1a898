"""The two batch jobs: analyse a corpus, and review what changed in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import limits as L
from corpuslens.operators import incremental as I
from corpuslens.operators.analysis import analyze, project_snapshot
from corpuslens.operators.report import graded, verdict_totals
from corpuslens.operators.review import (
    RetryPolicy,
    ReviewerFactory,
    build_request,
    offline_reviewer,
    review_or_explain,
)
from corpuslens.operators.storage import BROADCAST_ROWS, join_few, materialised, qualified, stages_dropped
from corpuslens.sources.answers import AnswerFolder, forget_answers, load_answers
from corpuslens.sources.files import read_text, scan_code_files
from corpuslens.sources.latest import LatestResults
from corpuslens.sources.sinks import (
    finished_runs,
    load_run_state,
    read_review_snapshot,
    save_run_state,
    write_review_snapshot,
)

KEYS = ["project", "path"]


def scan_project(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """A source tree as ``project, path, text, parse_error, mtime`` rows."""
    files = read_text(scan_code_files(spark, root)).withColumn("project", F.lit(project or root))
    return files.select("project", "path", "text", "parse_error", "mtime")


@dataclass
class ReviewOptions:
    model: str = "offline-rules"
    factory: ReviewerFactory = offline_reviewer
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    per_minute: int = L.MAX_REQUESTS_PER_MINUTE
    concurrency: int = L.MAX_CONCURRENT_REQUESTS
    answers_per_piece: int = 1
    min_run_interval: float = L.MIN_RUN_INTERVAL_SECONDS


def pending_requests(
    decided: DataFrame, files: DataFrame, analysis: DataFrame
) -> DataFrame:
    """Texts and structure join the pending entries only."""
    todo = decided.filter(F.col("action") == "pending").select(*KEYS, "rule_based_issues", "file_hash")
    texts = join_few(files.select(*KEYS, "text"), todo, KEYS)
    shape = join_few(
        analysis.select(*KEYS, "headers", "classes", "parse_error"), todo.select(*KEYS), KEYS, "left_semi"
    )
    rows = texts.join(shape, KEYS)
    return build_request(rows)


def review_run(
    files: DataFrame,
    folder: str,
    run_id: str,
    now: float,
    options: ReviewOptions | None = None,
    manifest: DataFrame | None = None,
    context: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One incremental run over ``files``; its results are stored under ``folder``.

    Files whose earlier answer still holds are taken over. The rest are
    reviewed, unless the project's last run is too recent. A project's run start
    is stored before the first call, and only where there is work to do.
    ``manifest`` may list files that are gone. ``context`` makes the structure rows
    that reviewers see of the ones of these files. The steps' own tables are removed
    at the end.

    Every answer is kept as soon as it is there, so a run that was killed asks
    nothing twice when it is tried again, under its own id or the next one: what it
    finds kept counts as generated, whatever the cooldown. A run id that is finished
    is not run again; its stored results are returned. What earlier runs said is
    looked up in the table of latest results, and texts are read for files taken
    over only.
    """
    spark = files.sparkSession
    folder = qualified(spark, folder)
    if run_id not in finished_runs(spark, folder):
        with stages_dropped(spark):
            latest = LatestResults(spark, folder)
            try:
                catch_up(latest, folder)
                _run(files, folder, run_id, now, options or ReviewOptions(), manifest, context or (lambda rows: rows), latest)
                catch_up(latest, folder)
            finally:
                latest.close()
    return read_review_snapshot(spark, folder, [run_id])


def catch_up(latest: LatestResults, folder: str) -> None:
    """Adds finished runs that the table of latest results does not hold yet."""
    spark, known = latest.spark, latest.added()
    for run_id in finished_runs(spark, folder):
        if run_id not in known:
            latest.add(read_review_snapshot(spark, folder, [run_id]), run_id)


def reused_texts(decided: DataFrame, folder: str) -> DataFrame:
    """Files taken over with their answer texts, out of the runs that hold them and no others.

    The narrow side is broadcast when it is small and hashed otherwise; texts are not sorted.
    """
    spark = decided.sparkSession
    reused = decided.filter(F.col("action") == "cached").drop("prev_analysis")
    # As many as there are runs.
    runs = [r["prev_run"] for r in reused.select("prev_run").distinct().collect()]
    texts = read_review_snapshot(spark, folder, runs).select(
        *KEYS, F.col("run_id").alias("prev_run"), F.col("ai_analysis").alias("prev_analysis")
    )
    few = F.broadcast(reused) if reused.count() <= BROADCAST_ROWS else reused.hint("shuffle_hash")
    return texts.join(few, [*KEYS, "prev_run"]).select(*decided.columns)


def _run(
    files: DataFrame,
    folder: str,
    run_id: str,
    now: float,
    options: ReviewOptions,
    manifest: DataFrame | None,
    context: Callable[[DataFrame], DataFrame],
    latest: LatestResults,
) -> None:
    spark, local = files.sparkSession, getattr(options.factory, "local", False)
    manifest = (files if manifest is None else manifest).select(*KEYS)
    # A file that cannot be read counts as missing: it is neither taken over nor reviewed as empty.
    facts = I.file_facts(files.filter(F.col("text").isNotNull()).select(*KEYS, "text", "mtime"))
    starts = load_run_state(spark, f"{folder}/state", besides=run_id)
    left = L.cooldown_remaining(
        F.lit(now), F.col("last_started_at"), F.lit(float(options.min_run_interval))
    )
    waits = starts.withColumn("_left", left).select("project", "_left")
    gated = join_few(manifest, waits, ["project"], "left")
    decided = I.decide_action(
        gated, facts, latest.join, KEYS, F.coalesce("_left", F.lit(0.0)), F.lit(None).cast("timestamp")
    )
    answers = materialised(load_answers(spark, folder, options.model))
    asked = F.col("action").isin("pending", "skipped")
    known = answers.select(*KEYS, "file_hash", F.lit(True).alias("_known"))
    decided = join_few(decided, known, [*KEYS, "file_hash"], "left").withColumn(
        "action", F.when(asked & F.col("_known").isNotNull(), "answered").otherwise(F.col("action"))
    )
    # Later steps read the decisions several times; the reviewer must see them once.
    decided = materialised(decided.drop("_left", "_known"))
    # Several steps need the parsed files; they are parsed once. A local reviewer gets no
    # documents, so that the structure of files that it is not asked about has no reader.
    pending = decided.filter(F.col("action") == "pending").select(*KEYS)
    parsed = join_few(files, pending, KEYS, "left_semi") if local else files
    analysis = materialised(analyze(parsed))
    requests = pending_requests(decided, files, analysis)
    reviewed, started = review_or_explain(
        requests,
        options.factory,
        ["project"],
        retry=options.retry,
        concurrency=options.concurrency,
        per_minute=options.per_minute,
        # A local reviewer costs nothing to ask again and answers out of the file alone.
        snapshot=None if local else materialised(project_snapshot(context(analysis))),
        answers=None if local else AnswerFolder(folder, run_id, options.model, options.answers_per_piece),
    )
    if started:
        began = decided.filter(F.col("action") == "pending").select("project").distinct()
        save_run_state(began.withColumn("started_at", F.lit(now)), f"{folder}/state", run_id)
    taken_up = decided.filter(F.col("action") == "answered").join(answers, [*KEYS, "file_hash"])
    results = I.merge_results(
        I.settled_results(decided.filter(~F.col("action").isin("cached", "answered")), ["project"]),
        I.settled_results(reused_texts(decided, folder), ["project"]),
        I.result_record(
            taken_up, ["project"], F.col("rule_based_issues"), F.lit("generated"), F.col("ai_analysis"), F.col("file_hash")
        ),
        reviewed,
    )
    write_review_snapshot(results, folder, run_id, options.model, F.timestamp_seconds(F.lit(now)))
    if not answers.isEmpty() or not local:
        forget_answers(spark, folder, run_id, decided)


def report_totals(results: DataFrame) -> DataFrame:
    """Problem, improve and good counts per project."""
    return verdict_totals(graded(results), ["project"])
