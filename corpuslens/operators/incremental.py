"""Which files need a new review, and how the results come together.

All of it runs on narrow columns (path, hash, times, short lists). File texts
join only the rows that are left to review.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.limits import cooldown_message
from corpuslens.functions.review_text import ERROR_PREFIX
from corpuslens.functions.text import content_hash, rule_checks

# Texts of results that no reviewer wrote.
FILE_NOT_FOUND = "[ERROR]\nFile not found on disk."
UNAVAILABLE = "[ERROR]\nAI analysis unavailable.\n\nReason: "


def _no_issues() -> Column:
    return F.array().cast("array<string>")


def dedupe_last(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The last row per key, as an aggregate: it combines before the shuffle.

    ``order`` may name several columns; later ones settle ties.
    """
    rest = [c for c in rows.columns if c not in keys]
    by = F.col(order) if isinstance(order, str) else F.struct(*order)
    last = F.max_by(F.struct(*rest), by).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*rows.columns)


def file_facts(files: DataFrame, text: str = "text") -> DataFrame:
    """Per file: hash and rule messages. Drops the text."""
    return files.withColumn("file_hash", content_hash(F.col(text))).withColumn(
        "rule_based_issues", rule_checks(F.col(text))
    ).drop(text)


def is_error_like(status: Column, analysis: Column) -> Column:
    return F.coalesce(status.isin("error", "skipped"), F.lit(False)) | F.coalesce(
        F.startswith(analysis, F.lit(ERROR_PREFIX)), F.lit(False)
    )


def can_reuse(
    found: Column,
    status: Column,
    analysis: Column,
    old_hash: Column,
    new_hash: Column,
    mtime: Column,
    report_mtime: Column,
) -> Column:
    """An earlier answer holds while the hash is the same.

    Without a stored hash the file must be no newer than the report.
    """
    same = F.when(old_hash.isNotNull(), old_hash == new_hash).otherwise(
        F.coalesce(mtime <= report_mtime, F.lit(False))
    )
    return F.coalesce(found, F.lit(False)) & ~is_error_like(status, analysis) & F.coalesce(same, F.lit(False))


def join_previous(files: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the earlier result of each file; ``prev_found`` tells whether there is one."""
    old = previous.select(
        *keys,
        F.lit(True).alias("prev_found"),
        F.col("ai_status").alias("prev_status"),
        F.col("ai_analysis").alias("prev_analysis"),
        F.col("file_hash").alias("prev_hash"),
    )
    return files.join(old, keys, "left")


def missing_files(manifest: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.join(files.select(*keys), keys, "left_anti")


def decide_action(
    manifest: DataFrame,
    facts: DataFrame,
    previous: DataFrame | Callable[[DataFrame], DataFrame],
    keys: list[str],
    cooldown: Column,
    report_mtime: Column,
) -> DataFrame:
    """Per manifest entry: ``error``, ``cached``, ``skipped`` or ``pending``.

    ``facts`` holds one row per existing file with ``file_hash``,
    ``rule_based_issues`` and ``mtime``; ``previous`` one row per key, or a function
    that adds to files what :func:`join_previous` adds.
    """
    here = facts.select(*keys, F.lit(True).alias("exists"), "file_hash", "rule_based_issues", "mtime")
    rows = manifest.join(here, keys, "left")
    joined = previous(rows) if callable(previous) else join_previous(rows, previous, keys)
    reuse = can_reuse(
        F.col("prev_found"),
        F.col("prev_status"),
        F.col("prev_analysis"),
        F.col("prev_hash"),
        F.col("file_hash"),
        F.col("mtime"),
        report_mtime,
    )
    return joined.withColumn("cooldown_remaining", cooldown).withColumn(
        "action",
        F.when(F.col("exists").isNull(), "error")
        .when(reuse, "cached")
        .when(F.col("cooldown_remaining") > 0, "skipped")
        .otherwise("pending"),
    )


def result_record(
    rows: DataFrame, keep: list[str], issues: Column, status: Column, analysis: Column, digest: Column
) -> DataFrame:
    """The five result fields beside the columns to keep."""
    fields = {
        "rule_based_issues": issues,
        "ai_status": status,
        "ai_analysis": analysis,
        "file_hash": digest,
    }
    return rows.select(*keep, "path", *[column.alias(name) for name, column in fields.items()])


def settled_results(decided: DataFrame, keep: list[str]) -> DataFrame:
    """Results of all entries that need no reviewer."""
    action = F.col("action")
    missing = action == "error"
    return result_record(
        decided.filter(action != "pending"),
        keep,
        F.when(missing, _no_issues()).otherwise(F.col("rule_based_issues")),
        action,
        F.when(missing, FILE_NOT_FOUND)
        .when(action == "cached", F.coalesce(F.col("prev_analysis"), F.lit("")))
        .otherwise(cooldown_message(F.col("cooldown_remaining"))),
        F.when(missing, "").otherwise(F.col("file_hash")),
    )


def unavailable_results(pending: DataFrame, keep: list[str], reason: str) -> DataFrame:
    """All pending entries as errors, when no reviewer could be made."""
    return result_record(
        pending,
        keep,
        F.col("rule_based_issues"),
        F.lit("error"),
        F.lit(UNAVAILABLE + reason),
        F.col("file_hash"),
    )


def merge_results(*branches: DataFrame) -> DataFrame:
    """Disjoint result branches as one set."""
    return reduce(lambda left, right: left.unionByName(right), branches)


def order_results(manifest: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results of the manifest entries, with their place; one row per entry."""
    return manifest.select(*keys, "pos").join(results, keys)


def status_counts(results: DataFrame, group: list[str]) -> DataFrame:
    count = lambda status: F.count_if(F.col("ai_status") == status)
    return results.groupBy(*group).agg(
        count("generated").alias("generated"),
        count("cached").alias("cached"),
        count("skipped").alias("skipped"),
        count("error").alias("errors"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``added``, ``removed``, ``changed`` or ``same`` per key.

    Records are compared by a digest of all their fields, so only keys and
    digests are shuffled.
    """
    digest = lambda rows: F.sha2(
        F.to_json(F.struct(*[c for c in sorted(rows.columns) if c not in keys])), 256
    )
    left = old.select(*keys, digest(old).alias("old"))
    right = new.select(*keys, digest(new).alias("new"))
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") == F.col("new"), "same")
        .otherwise("changed")
        .alias("change"),
    )


