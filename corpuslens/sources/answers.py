"""Answers that are kept the moment they are there, before their run ends.

A reviewing task writes each few answers as one piece under
``answers/run_id=../slot=..``: the bytes go to a hidden name first and the finished
file is renamed, so a piece is whole or not there. A task that is run again finds
the pieces of its slot and asks nothing twice; a run that was killed is taken up by
the next one, which counts what it finds as answered. Pieces are removed once a
finished run holds what they say.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.storage import remove_folder
from corpuslens.sources.files import open_store

KEY = ["project", "path", "file_hash"]
PIECE = pa.schema([(name, pa.string()) for name in [*KEY, "model", "ai_analysis"]])
STORED = "project string, path string, file_hash string, model string, ai_analysis string, run_id string, slot int"


@dataclass(frozen=True)
class AnswerFolder:
    """Where a run's tasks keep answers: ``folder`` is a URI that all executors reach.

    With one answer to a piece no answer that a task has received is ever asked
    for again. A reviewer that gives thousands a second can take more to a piece;
    what is lost with a task is then less than one piece.
    """

    folder: str
    run_id: str
    model: str
    per_piece: int = 1

    def open(self, slot: int) -> AnswerLog:
        return AnswerLog(self, slot)


class AnswerLog:
    """One task's side of an :class:`AnswerFolder`."""

    def __init__(self, where: AnswerFolder, slot: int):
        self.where, self.held = where, []
        self.store, top = open_store(where.folder)
        self.place = f"{top}/answers/run_id={where.run_id}/slot={slot}"
        self.pieces: dict[tuple, str] = {}
        listed = self.store.get_file_info(fs.FileSelector(self.place, allow_not_found=True))
        for info in listed:
            if info.base_name.startswith("piece-"):
                for row in self._rows(info.path, [*KEY, "model"]):
                    if row["model"] == where.model:
                        self.pieces[tuple(row[k] for k in KEY)] = info.path

    def _rows(self, path: str, columns: list[str]) -> list[dict]:
        with self.store.open_input_file(path) as file:
            return pq.read_table(file, columns=columns).to_pylist()

    def known(self, row: Mapping[str, Any]) -> str | None:
        """The answer that an earlier attempt of this task has kept; only keys are held in memory."""
        key = tuple(row[k] for k in KEY)
        path = self.pieces.get(key)
        if path is None:
            return None
        return next(r["ai_analysis"] for r in self._rows(path, [*KEY, "ai_analysis"]) if tuple(r[k] for k in KEY) == key)

    def keep(self, row: Mapping[str, Any], analysis: str) -> None:
        self.held.append({**{k: row[k] for k in KEY}, "model": self.where.model, "ai_analysis": analysis})
        if len(self.held) >= self.where.per_piece:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        name = f"{uuid.uuid4().hex}.parquet"
        self.store.create_dir(self.place, recursive=True)
        with self.store.open_output_stream(f"{self.place}/_open-{name}") as out:
            pq.write_table(pa.Table.from_pylist(self.held, PIECE), out)
        self.store.move(f"{self.place}/_open-{name}", f"{self.place}/piece-{name}")
        self.held = []


def load_answers(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Kept answers of one model that no finished run holds yet: a row for each key, with its ``run_id``."""
    try:
        stored = spark.read.schema(STORED).parquet(f"{folder}/answers")
    except AnalysisException:
        stored = spark.createDataFrame([], STORED)
    # Two attempts may have kept the same key; one of the answers is as good as the other.
    return stored.where(F.col("model") == model).groupBy(*KEY).agg(
        F.min("ai_analysis").alias("ai_analysis"), F.min("run_id").alias("run_id")
    )


def forget_answers(spark: SparkSession, folder: str, run_id: str, finished: DataFrame) -> None:
    """Removes the pieces of a finished run, and those of killed runs whose files it reports."""
    try:
        stored = spark.read.schema(STORED).parquet(f"{folder}/answers")
    except AnalysisException:
        return
    files = stored.select("run_id", "project", "path").distinct()
    left = files.join(finished.select("project", "path"), ["project", "path"], "left_anti").select("run_id").distinct()
    # One row for each run that was killed.
    gone = files.select("run_id").distinct().join(left, "run_id", "left_anti").collect()
    for name in {run_id, *(r["run_id"] for r in gone)}:
        remove_folder(spark, f"{folder}/answers/run_id={name}")
