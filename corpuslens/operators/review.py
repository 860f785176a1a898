"""Requests to a reviewer and its answers.

The reviewer is a callable made once per task by a factory the caller passes
in. It gets a mapping with ``path``, ``request``, ``rule_based_issues`` and, where
documents are given, the project's whole document as ``context`` (a
:class:`ProjectDocument`; :func:`request_parts` puts request and document together),
and returns the answer text. Nothing here talks to a network.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corpuslens.functions import limits as L
from corpuslens.operators import admission as A
from corpuslens.operators.analysis import document_start
from corpuslens.operators.incremental import UNAVAILABLE, unavailable_results
from corpuslens.operators.order import with_positions
from corpuslens.operators.storage import materialised
from corpuslens.sources.answers import AnswerFolder, AnswerLog

Reviewer = Callable[[Mapping[str, Any]], str]
ReviewerFactory = Callable[[], Reviewer]

# Fixed value: stands in when the parser had nothing to report.
PARSER_OK = "Parser completed without file-level errors."


# A request begins with this; the project's document follows it.
REQUEST_START = (
    "Review one C or C++ file as part of its project. Answer with the three sections "
    "[SUMMARY], [ISSUES] and [SUGGESTIONS], each marker on a line of its own.\n\n## Project\n"
)


def build_request(rows: DataFrame) -> DataFrame:
    """Adds ``request``: what a reviewer needs to know about one file, but for the project's document.

    The document stands beside it, held once in a task for all files of a project.
    """
    section = lambda title, body: F.concat(F.lit(f"\n\n## {title}\n"), body)
    return rows.withColumn(
        "request",
        F.concat(
            F.lit(REQUEST_START),
            section("Path", F.col("path")),
            section("Includes", F.to_json("headers")),
            section("Types", F.to_json("classes")),
            section("Parser", F.coalesce(F.nullif(F.col("parse_error"), F.lit("")), F.lit(PARSER_OK))),
            section("Code", F.concat(F.lit("```cpp\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))),
        ),
    )


def attach_context(pending: DataFrame, snapshot: DataFrame, tasks: int) -> DataFrame:
    """Deals requests to ``tasks`` partitions, each behind its project's document.

    Rows of the document's pieces (``_part`` and ``_piece`` set) come before the
    requests of their project (both null), in order. A project's requests are
    spread over all tasks, and a task gets each piece once, whatever the number
    of requests: what is shuffled grows with the texts, not with files times
    documents.
    """
    slot = F.pmod(F.xxhash64("project", "path"), F.lit(tasks)).cast("int").alias("_slot")
    asked = pending.select("project", slot).distinct()
    # Numbers are filled in, so that a null does not turn a whole pandas column into floats.
    blank = {
        f.name: F.lit(0 if isinstance(f.dataType, NumericType) else None).cast(f.dataType)
        for f in pending.schema if f.name != "project"
    }
    pieces = snapshot.withColumn("_root", F.concat(document_start(), F.lit(',"files":['))).join(asked, "project").select(
        *[blank[c].alias(c) if c in blank else c for c in pending.columns],
        "_slot",
        F.col("part").alias("_part"),
        F.when(F.col("part") == 0, F.concat("_root", "records")).otherwise(F.concat(F.lit(","), "records")).alias("_piece"),
    )
    rows = pending.select("*", slot, F.lit(None).cast("bigint").alias("_part"), F.lit(None).cast("string").alias("_piece"))
    dealt = rows.unionByName(pieces).repartitionById(tasks, F.col("_slot"))
    return dealt.sortWithinPartitions("project", F.asc_nulls_last("_part")).drop("_slot")


class ProjectDocument:
    """A project's whole document as the pieces it came in: iterate to read it, ``str`` to have it in one text.

    All requests of a project in a task share one object, so a reviewer can keep what
    it makes of it (a digest, a cached prompt) beside the object itself.
    """

    def __init__(self, project: str | None = None) -> None:
        self.project, self.pieces = project, []

    def __iter__(self) -> Iterator[str]:
        yield from self.pieces
        if self.pieces:
            yield "]}"

    def __bool__(self) -> bool:
        return bool(self.pieces)

    def __str__(self) -> str:
        return "".join(self)


def request_parts(row: Mapping[str, Any]) -> Iterator[str]:
    """A whole request with its project's document, in parts that are never copied together."""
    yield REQUEST_START
    yield from row.get("context") or ()
    yield row["request"].removeprefix(REQUEST_START)


def offline_reviewer() -> Reviewer:
    """Deterministic answers out of the rule messages alone."""

    def review(request: Mapping[str, Any]) -> str:
        issues = list(request["rule_based_issues"])
        found = "\n".join(f"- {issue}" for issue in issues) or "None"
        advice = "Resolve the rule findings." if issues else ""
        return f"[SUMMARY]\nRule review of {request['path']}.\n\n[ISSUES]\n{found}\n\n[SUGGESTIONS]\n{advice}"

    return review


offline_reviewer.local = True


def is_available(factory: ReviewerFactory) -> str | None:
    """None when a reviewer can be made, else the reason."""
    try:
        factory()
    except Exception as error:  # noqa: BLE001
        return str(error)
    return None


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = L.MAX_ATTEMPTS
    initial: float = L.INITIAL_BACKOFF_SECONDS
    multiplier: float = L.BACKOFF_MULTIPLIER
    most: float = L.MAX_BACKOFF_SECONDS

    def pause(self, retry: int) -> float:
        first = max(0.0, self.initial)
        return first if retry == 1 else min(self.most, first * max(1.0, self.multiplier) ** (retry - 1))


@dataclass
class Clock:
    """Time as tasks see it; tests use one that only counts."""

    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


@dataclass
class Quota:
    """At most ``limit`` calls of this task in any window."""

    limit: int
    clock: Clock
    window: float = 60.0
    sent: deque = field(default_factory=deque)

    def wait(self) -> float:
        if len(self.sent) == self.limit:
            self.clock.sleep(max(0.0, self.sent[0] + self.window - self.clock.now()))
            self.sent.popleft()
        now = self.clock.now()
        self.sent.append(now)
        return now


def task_share(limit: int, tasks: int, task: int) -> int:
    """This task's part of a limit; the parts of all tasks add up to it."""
    return limit // tasks + (1 if task < limit % tasks else 0)


def with_slots(requests: DataFrame, per_minute: int, tasks: int, start_us: int, window_us: int = A.MINUTE_US) -> DataFrame:
    """Adds ``send_at``, when each request may go out, in order of path, and ``send_task``, which task sends it.

    The slots are the admission schedule of a queue that is full from ``start_us`` on:
    ``per_minute`` a window. A window's slots are dealt to the tasks by their shares.
    """
    placed = with_positions(requests.withColumn("_all", F.lit("all")), [F.col("path")], ["_all"], "_place").drop("_all")
    window = F.floor(F.col("_place") / per_minute).cast("bigint")
    return (
        placed.withColumn("send_at", F.lit(start_us).cast("bigint") + window * window_us)
        .withColumn("send_task", (F.col("_place") % per_minute % tasks).cast("int"))
        .drop("_place")
    )


def review_by_schedule(
    pending: DataFrame,
    factory: ReviewerFactory,
    keep: list[str],
    per_minute: int,
    start_us: int,
    retry: RetryPolicy = RetryPolicy(),
    concurrency: int = L.MAX_CONCURRENT_REQUESTS,
    window_us: int = A.MINUTE_US,
) -> DataFrame:
    """Reviews in waves; every call goes out at its slot of one schedule for all tasks.

    A call that is late, because the one before it took long, keeps to its task's share
    of the limit, so no window ever sees more than ``per_minute`` calls.

    The first wave asks for every row. What failed for a passing reason is the next
    wave, with slots of its own behind the last ones and behind the pause before a
    retry, up to ``retry.attempts`` waves. Returns the rows of :func:`review_files`
    with ``attempts`` and ``send_at`` of the last call; each wave is stored before
    the next begins. A path names one request.
    """
    left, done, at, tasks = pending, [], start_us, max(1, min(concurrency, per_minute))
    for attempt in range(1, max(1, retry.attempts) + 1):
        slotted = materialised(with_slots(left, per_minute, tasks, at, window_us))
        once = RetryPolicy(attempts=1)
        kept = list(dict.fromkeys([*keep, "path", "send_at"]))
        answers = materialised(
            review_files(slotted, factory, kept, once, tasks, per_minute, window=window_us / 1e6)
            .withColumn("attempts", F.lit(attempt))
        )
        reason = F.substring("ai_analysis", len(UNAVAILABLE) + 1, 1 << 30)
        again = (F.col("ai_status") == "error") & L.is_retryable_error(reason) & F.lit(attempt < retry.attempts)
        done.append(answers.where(~again))
        left = pending.join(answers.where(again).select("path"), "path", "left_semi")
        last = answers.where(again).agg(F.count("*"), F.max("send_at")).first()
        if not last[0]:
            break
        ends = slotted.agg(F.max("send_at")).first()[0]
        at = max(ends + window_us, last[1] + int(retry.pause(attempt) * 1_000_000))
    return reduce(DataFrame.unionByName, done).drop("first_call", "last_call")


ANSWER = "ai_status string, ai_analysis string, attempts int, first_call double, last_call double"


def review_files(
    pending: DataFrame,
    factory: ReviewerFactory,
    keep: list[str],
    retry: RetryPolicy = RetryPolicy(),
    concurrency: int = L.MAX_CONCURRENT_REQUESTS,
    per_minute: int = 0,
    clock: Callable[[], Clock] = Clock,
    snapshot: DataFrame | None = None,
    answers: AnswerFolder | None = None,
    window: float = 60.0,
) -> DataFrame:
    """Calls the reviewer for every pending row; failures come back as rows.

    With a stored ``snapshot`` of the projects each request of :func:`build_request`
    comes with its project's whole document; ``pending`` then needs ``project``.

    There are as many tasks as calls may be open at once, each with its own
    reviewer, made when first needed. A limit per minute is split among the
    tasks, so it holds for the whole job without talk between them; every
    attempt takes a slot. A task that is run again first lets a window pass.

    With ``answers`` (then ``pending`` needs ``project`` and ``file_hash``) every
    answer is kept there before the next call is made, and a task that is run again
    takes what its earlier attempts have kept (0 attempts, no call times).
    Speculative copies would ask twice, so they are refused.

    With the columns of :func:`with_slots` a row is sent by its task, not before its time.

    A factory with the attribute ``local`` makes reviewers that need no limit: its
    rows stay in the tasks they are in, unless documents or answers are asked for.
    """
    if answers is not None and pending.sparkSession.conf.get("spark.speculation", "false") == "true":
        raise ValueError("Speculative tasks would ask the reviewer twice: set spark.speculation to false")
    tasks = max(1, min(concurrency, per_minute) if per_minute > 0 else concurrency)
    named = ["project"] if snapshot is not None else []
    named += ["project", "file_hash"] if answers is not None else []
    slotted = "send_task" in pending.columns
    named += ["send_at", "send_task"] if slotted else []
    kept = pending.select(*dict.fromkeys([*keep, *named, "path", "request", "rule_based_issues"]))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keep).schema)

    with_documents = snapshot is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log = answers.open(TaskContext.get().partitionId()) if answers is not None else None
        try:
            yield from ask(batches, log)
        finally:
            if log:
                log.flush()

    def ask(batches: Iterator[pd.DataFrame], log: AnswerLog | None) -> Iterator[pd.DataFrame]:
        context, own_clock, reviewer, document = TaskContext.get(), clock(), None, ProjectDocument()
        quota = None
        if per_minute > 0:
            quota = Quota(task_share(per_minute, tasks, context.partitionId() % tasks), own_clock, window)
            if context.attemptNumber() > 0:
                own_clock.sleep(quota.window)
        for batch in batches:
            said, rows = [], batch.to_dict("records")
            if with_documents:
                batch = batch[batch["_piece"].isna()]
            for row in rows:
                if with_documents:
                    if isinstance(row["_piece"], str):
                        if row["project"] != document.project:
                            document = ProjectDocument(row["project"])
                        document.pieces.append(row["_piece"])
                        continue
                    own = row["project"] is not None and row["project"] == document.project
                    row["context"] = document if own else ProjectDocument()
                if log and (kept_answer := log.known(row)) is not None:
                    said.append(("generated", kept_answer, 0, None, None))
                    continue
                calls: list[float] = []
                while True:
                    try:
                        if "send_at" in row:
                            own_clock.sleep(max(0.0, row["send_at"] / 1e6 - time.time()))
                        calls.append(quota.wait() if quota else own_clock.now())
                        reviewer = reviewer or factory()
                        said.append(("generated", reviewer(row) or "", len(calls), calls[0], calls[-1]))
                        break
                    except Exception as error:  # noqa: BLE001
                        reason = str(error)
                        if len(calls) >= retry.attempts or not L.retryable(reason):
                            said.append(("error", UNAVAILABLE + reason, len(calls), calls[0], calls[-1]))
                            break
                        own_clock.sleep(retry.pause(len(calls)))
                if log and said[-1][0] == "generated":
                    log.keep(row, said[-1][1])
            columns = ["ai_status", "ai_analysis", "attempts", "first_call", "last_call"]
            answered = pd.DataFrame(said, columns=columns, index=batch.index)
            if said:
                yield pd.concat([batch[keep], answered], axis=1)

    if with_documents:
        dealt = attach_context(kept, snapshot, tasks)
    elif slotted:
        dealt = kept.repartitionById(tasks, F.col("send_task")).sortWithinPartitions("send_at", "path")
    elif answers is not None:
        dealt = kept.repartitionById(tasks, F.pmod(F.xxhash64("project", "path"), F.lit(tasks)).cast("int"))
    elif getattr(factory, "local", False) and per_minute <= 0:
        dealt = kept
    else:
        dealt = kept.repartition(tasks)
    return dealt.mapInPandas(run, f"{schema}, {ANSWER}")


def review_or_explain(
    pending: DataFrame, factory: ReviewerFactory, keep: list[str], **options: Any
) -> tuple[DataFrame, bool]:
    """Reviewed rows, or error rows when no reviewer can be made at all.

    The second value tells whether the run counts as started.
    """
    fields = ["path", "rule_based_issues", "file_hash"]
    reason = is_available(factory)
    if reason is not None:
        return unavailable_results(pending, keep, reason), False
    answers = review_files(pending, factory, [*keep, *fields], **options)
    return answers.select(
        *keep, "path", "rule_based_issues", "ai_status", "ai_analysis", "file_hash"
    ), True
