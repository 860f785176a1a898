"""From file rows to the analysis table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.paths import path_order
from corpuslens.operators.order import with_positions
from corpuslens.operators.parse import with_structure
from corpuslens.operators.storage import materialised
from corpuslens.schemas import CLASSES


def row_error_capture(files: DataFrame) -> DataFrame:
    """Files that could not be read keep their row but have empty lists.

    Bytes that are no UTF-8 are no reason: the structure of such a file is that of
    the text they were read as, beside its ``parse_error``.
    """
    bad = F.col("text").isNull()
    return files.withColumn(
        "headers", F.when(bad, F.array().cast("array<string>")).otherwise(F.col("headers"))
    ).withColumn("classes", F.when(bad, F.array().cast(CLASSES)).otherwise(F.col("classes")))


def analyze(files: DataFrame) -> DataFrame:
    """``project, path, text, parse_error`` rows to ``file_analysis`` rows. No shuffle."""
    parsed = row_error_capture(with_structure(files))
    return parsed.select("project", "path", "headers", "classes", "parse_error")


def diagnostics(analysis: DataFrame) -> DataFrame:
    """One warning per file that could not be parsed."""
    return analysis.filter(F.col("parse_error") != "").select(
        "project",
        "path",
        F.lit("parse").alias("stage"),
        F.concat(
            F.lit("Failed to parse "), F.col("path"), F.lit(": "), F.col("parse_error")
        ).alias("message"),
    )


def file_record() -> Column:
    """One file as it stands in an analysis document."""
    return F.struct("path", "headers", "classes", "parse_error")


FILES_PER_PART = 500  # how many files travel in one row; what a project's document holds does not depend on it


def project_snapshot(analysis: DataFrame, files_per_part: int = FILES_PER_PART) -> DataFrame:
    """Each project's analysis document in pieces: ``project, part, first, files, records``.

    ``records`` are the files of one piece in path order, parted by commas, and
    ``first`` is the place of the piece's first file in the project. No group
    grows with the project; the pieces in order are the whole document.
    """
    # Written once: sorting samples its input, which must not parse all files again.
    slim = materialised(
        analysis.select("project", "path", F.to_json(file_record()).alias("record"))
    )
    keys = ["project", "path"]
    places = with_positions(slim.select(*keys), [path_order(F.col("path"))], ["project"])
    placed = slim.join(places, keys)
    part = F.floor(F.col("pos") / files_per_part).cast("bigint").alias("part")
    pieces = placed.groupBy("project", part).agg(
        F.min("pos").alias("first"),
        F.count("*").alias("files"),
        F.array_sort(F.collect_list(F.struct("pos", "record"))).alias("rows"),
    )
    records = F.array_join(F.transform("rows", lambda r: r["record"]), ",")
    return pieces.select("project", "part", "first", "files", records.alias("records"))


def document_start() -> Column:
    """A document up to its list of files: ``{"root":"name"``."""
    root = F.regexp_replace(F.to_json(F.array("project")), r"\A\[|\]\z", "")
    return F.concat(F.lit('{"root":'), root)


def document_pieces(snapshot: DataFrame) -> DataFrame:
    """Adds ``project_files`` and ``document``, the text of a piece as it stands in the whole document.

    A project's texts, put together in order of ``part``, are its document
    ``{root, files}`` from the first character to the last, whatever its size.
    The snapshot is read twice: pass it stored.
    """
    # One row per project.
    whole = snapshot.groupBy("project").agg(F.sum("files").alias("project_files"), F.max("part").alias("_last"))
    names = whole.withColumnRenamed("project", "_project")
    rows = snapshot.join(names, F.col("project").eqNullSafe(F.col("_project")))
    start = F.when(F.col("part") == 0, F.concat(document_start(), F.lit(',"files":['))).otherwise(F.lit(","))
    end = F.when(F.col("part") == F.col("_last"), F.lit("]}")).otherwise(F.lit(""))
    return rows.withColumn("document", F.concat(start, "records", end)).drop("_project", "_last")


def project_documents(snapshot: DataFrame, whole: bool = True) -> DataFrame:
    """Whole documents ``{root, files}``: a row ``project, files, document`` for each project.

    For readers that want one text for a project, which then has to fit a row.
    Reviews take the pieces instead. Without ``whole`` a document comes as the rows
    of :func:`document_pieces`, however large it is; these are not stored on the way,
    as a reader of stored rows holds thousands of them at once.
    """
    if not whole:
        return document_pieces(snapshot)
    # Written once, then dealt to a fixed number of tasks: many short documents cost time each, whatever their bytes.
    tasks = int(snapshot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = materialised(snapshot).repartition(tasks, "project").groupBy("project").agg(
        F.sum("files").alias("files"), F.array_sort(F.collect_list(F.struct("part", "records"))).alias("parts")
    )
    body = F.array_join(F.transform("parts", lambda p: p["records"]), ",")
    return whole.select(
        "project", "files", F.concat(document_start(), F.lit(',"files":['), body, F.lit("]}")).alias("document")
    )
