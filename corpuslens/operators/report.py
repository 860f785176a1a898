"""Grading of review results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import review_text as R
from corpuslens.functions.arrays import pinned


def with_flags(results: DataFrame) -> DataFrame:
    status, analysis = F.col("ai_status"), F.col("ai_analysis")
    return (
        results.withColumn("is_error", R.is_error(status, analysis))
        .withColumn("is_skipped", R.is_skipped(status, analysis))
        .withColumn("is_cached", status == "cached")
    )


def _lines() -> Column:
    return F.split("ai_analysis", "\n", -1)


def _fenced() -> Column:
    return R.fence_state(F.col("_lines"))


def _section_marks() -> Column:
    return R.section_marks(F.col("_fenced"))


def _summary() -> Column:
    return R.extract_section(F.col("_lines"), F.col("_marks"), "SUMMARY")


def _issues() -> Column:
    return R.extract_section(F.col("_lines"), F.col("_marks"), "ISSUES")


def _suggestions() -> Column:
    return R.extract_section(F.col("_lines"), F.col("_marks"), "SUGGESTIONS")


def _has_issues() -> Column:
    return R.meaningful_issues(F.col("issues"))


def with_sections(results: DataFrame) -> DataFrame:
    """Adds ``summary``, ``issues`` and ``suggestions`` of every answer."""
    return pinned(
        results,
        _lines=_lines,
        _fenced=_fenced,
        _marks=_section_marks,
        summary=_summary,
        issues=_issues,
        suggestions=_suggestions,
    ).drop("_lines", "_fenced", "_marks")


def graded(results: DataFrame) -> DataFrame:
    """Adds flags, sections and ``verdict``. Errors and skips have no sections."""
    rows = with_sections(with_flags(results))
    for name in ("summary", "issues", "suggestions"):
        rows = rows.withColumn(
            name, F.when(F.col("is_error") | F.col("is_skipped"), "").otherwise(F.col(name))
        )
    rows = pinned(rows, has_issues=_has_issues)
    return rows.withColumn(
        "verdict",
        R.verdict(
            F.col("is_error"),
            F.col("is_skipped"),
            F.col("rule_based_issues"),
            F.col("has_issues"),
            F.col("suggestions"),
        ),
    )


def file_report_row(results: DataFrame) -> DataFrame:
    """What the report shows per file: only the parts that apply."""
    rows = graded(results)
    quiet = F.col("is_error") | F.col("is_skipped")
    return rows.withColumn(
        "message", F.when(quiet, F.col("ai_analysis")).otherwise("")
    ).withColumn("from_cache", ~quiet & F.col("is_cached")).withColumn(
        "issues", F.when(F.col("has_issues"), F.col("issues")).otherwise("")
    ).drop("is_error", "is_skipped", "is_cached", "has_issues", "ai_analysis")


def verdict_totals(graded_rows: DataFrame, group: list[str]) -> DataFrame:
    count = lambda verdict: F.count_if(F.col("verdict") == verdict)
    return graded_rows.groupBy(*group).agg(
        count("PROBLEM").alias("problems"),
        count("IMPROVE").alias("improve"),
        count("GOOD").alias("good"),
        F.count("*").alias("total"),
    )
