"""JSON documents: analyses and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pinned
from corpuslens.functions.review_text import default_status
from corpuslens.operators.incremental import dedupe_last
from corpuslens.schemas import ANALYSIS_DOCUMENT, CLASSES
from corpuslens.sources.json_pieces import in_pieces


def load_analysis_doc(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Analysis documents as rows ``project, pos, path, headers, classes, parse_error``.

    One object per line, as :func:`corpuslens.sources.sinks.write_snapshot` writes
    them, so a line is the unit of parallel reading; with ``multi_line`` each file is
    one document, laid out over lines in any way, which is read as a stream and
    handed on in pieces. ``pos`` is the file's place in its project.
    """
    if multi_line:
        documents = _laid_out_documents(spark, path)
    else:
        documents = spark.read.schema(ANALYSIS_DOCUMENT).json(path).withColumn("base", F.lit(0))
    return documents.select(
        F.col("root").alias("project"), "first", "base", F.posexplode("files").alias("pos", "file")
    ).select(
        "project",
        (F.coalesce("first", F.lit(0)) + F.col("base") + F.col("pos")).cast("bigint").alias("pos"),
        "file.path",
        F.coalesce("file.headers", F.array().cast("array<string>")).alias("headers"),
        F.coalesce("file.classes", F.array().cast(CLASSES)).alias("classes"),
        F.coalesce("file.parse_error", F.lit("")).alias("parse_error"),
    )


def _laid_out_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one file each: plain ones in pieces from ``base`` on, others whole by Spark's own reader."""
    # Only names are asked for, so no content is read here.
    files = spark.read.format("binaryFile").load(path).select("path")
    pieces, others = in_pieces(files)
    parsed = pinned(pieces, value=F.from_json("document", ANALYSIS_DOCUMENT)).select("value.*", "base")
    if not others:
        return parsed
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", other) for other in others]
    whole = spark.read.schema(ANALYSIS_DOCUMENT).option("multiLine", True).json(paths)
    return parsed.unionByName(whole.withColumn("base", F.lit(0).cast("bigint")))


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, one to a file, as rows ``file, document`` for the two readers below."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("document")
    )


@contextmanager
def _last_key_wins(spark: SparkSession) -> Iterator[None]:
    """JSON values made inside take the last of a key's values; the session's setting comes back afterwards."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column, path: str) -> Column:
    """A string member; null when it is missing or of another type."""
    member = F.try_variant_get(value, path, "variant")
    return F.when(_type_of(member) == "STRING", F.try_variant_get(value, path, "string"))


def load_prev_report(reports: DataFrame, document: str = "document") -> DataFrame:
    """Earlier results from report documents, read leniently.

    A broken document, or one whose results are no list, gives no rows; entries
    that are no object or have no text path are left out; of several entries for
    one path the last wins, and of a key's several values in one object. Other
    columns of ``reports`` are kept as keys.
    """
    keys = [c for c in reports.columns if c != document]
    with _last_key_wins(reports.sparkSession):
        parsed = reports.select(*keys, F.try_parse_json(document).alias("_value"))
    results = F.try_variant_get("_value", "$.results", "array<variant>")
    rows = parsed.select(*keys, F.posexplode(results).alias("pos", "entry"))
    entry = F.col("entry")
    issues = F.try_variant_get(entry, "$.rule_based_issues", "array<string>")
    flat = rows.filter(F.startswith(_type_of(entry), F.lit("OBJECT"))).select(
        *keys,
        "pos",
        _text(entry, "$.path").alias("path"),
        _text(entry, "$.ai_status").alias("ai_status"),
        _text(entry, "$.ai_analysis").alias("ai_analysis"),
        _text(entry, "$.file_hash").alias("file_hash"),
        F.coalesce(issues, F.array().cast("array<string>")).alias("rule_based_issues"),
    )
    return dedupe_last(flat.filter(F.col("path").isNotNull()), [*keys, "path"], "pos").drop("pos")


REPORT_SCHEMA = (
    "struct<model:string,results:array<struct<path:string,ai_status:string,"
    "ai_analysis:string,rule_based_issues:array<string>>>>"
)

# Reasons given for a report that cannot be used.
BROKEN_REPORT = "Failed to read AI report"
NO_RESULTS = "AI report is missing the 'results' section."


def _is_one_json_value(text: Column) -> Column:
    """True when the text is one whole JSON value with nothing behind it.

    ``try_parse_json`` stops at the end of the first value. Text after it would
    become a second element of a list, or break one of the two wrappings.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return (
        F.try_parse_json(text).isNotNull()
        & listed.isNotNull()
        & boxed.isNotNull()
        & F.try_variant_get(listed, "$[1]", "variant").isNull()
    )


def _is_text_or_missing(value: Column, path: str) -> Column:
    member = F.try_variant_get(value, path, "variant")
    return F.coalesce(_type_of(member).isin("STRING", "VOID"), F.lit(True))


def _is_text_list_or_missing(value: Column, path: str) -> Column:
    member = F.try_variant_get(value, path, "variant")
    items = F.try_variant_get(member, "$", "array<variant>")
    texts = F.startswith(_type_of(member), F.lit("ARRAY")) & F.forall(
        items, lambda item: F.coalesce(_type_of(item) == "STRING", F.lit(False))
    )
    return F.coalesce((_type_of(member) == "VOID") | texts, F.lit(True))


def _entry_is_typed(entry: Column) -> Column:
    return F.startswith(_type_of(entry), F.lit("OBJECT")) & (
        _is_text_or_missing(entry, "$.path")
        & _is_text_or_missing(entry, "$.ai_status")
        & _is_text_or_missing(entry, "$.ai_analysis")
        & _is_text_list_or_missing(entry, "$.rule_based_issues")
    )


def check_report(reports: DataFrame, document: str = "document") -> DataFrame:
    """Adds ``report_error``, empty for a document that follows the format.

    Of a key's several values in one object the last counts. A model that is no
    text is an error of the format, whether or not there are results.
    """
    with _last_key_wins(reports.sparkSession):
        return _checked(reports, document)


def _checked(reports: DataFrame, document: str) -> DataFrame:
    text = F.col(document)
    value = F.try_parse_json(text)
    results = F.try_variant_get(value, "$.results", "variant")
    entries = F.try_variant_get(results, "$", "array<variant>")
    whole = _is_one_json_value(text) & F.startswith(_type_of(value), F.lit("OBJECT"))
    named = _is_text_or_missing(value, "$.model")
    typed = (
        F.startswith(_type_of(results), F.lit("ARRAY"))
        & F.coalesce(F.forall(entries, _entry_is_typed), F.lit(False))
    )
    return reports.withColumn(
        "report_error",
        F.when(~F.coalesce(whole & named, F.lit(False)), BROKEN_REPORT)
        .when(results.isNull(), NO_RESULTS)
        .when(~F.coalesce(typed, F.lit(False)), BROKEN_REPORT)
        .otherwise(""),
    )


def parse_report_strict(reports: DataFrame, document: str = "document") -> DataFrame:
    """Results of well-formed reports with all defaults filled in."""
    keys = [c for c in reports.columns if c != document]
    good = check_report(reports, document).filter(F.col("report_error") == "")
    parsed = good.select(*keys, F.from_json(document, REPORT_SCHEMA).alias("report"))
    rows = parsed.select(
        *keys,
        F.col("report.model").alias("model"),
        F.posexplode("report.results").alias("pos", "entry"),
    )
    return json_defaults(
        rows.select(
            *keys,
            "model",
            F.col("pos").cast("bigint").alias("pos"),
            "entry.path",
            "entry.ai_status",
            "entry.ai_analysis",
            "entry.rule_based_issues",
        )
    )


def json_defaults(results: DataFrame) -> DataFrame:
    """Fills what a report may leave out; null and missing count the same."""
    analysis = F.coalesce(F.col("ai_analysis"), F.lit(""))
    return (
        results.withColumn("model", F.coalesce(F.col("model"), F.lit("unknown")))
        .withColumn("path", F.coalesce(F.col("path"), F.lit("<unknown>")))
        .withColumn("ai_status", default_status(F.col("ai_status"), analysis))
        .withColumn("ai_analysis", analysis)
        .withColumn(
            "rule_based_issues",
            F.coalesce(F.col("rule_based_issues"), F.array().cast("array<string>")),
        )
    )


