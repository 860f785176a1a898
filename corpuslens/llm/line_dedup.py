"""Line dedup with levelled, sorted runs of line hashes.

``LineRuns`` holds every line key that was ever seen, once, in sorted runs: a
new batch is counted per key, merge-anti-joined with the runs, and what is new
becomes a run of its own; keys that are known already go to a log of later
sightings. When a level has ``fan_out`` runs they are merged into one of the
next level. Runs are bucketed and sorted by key, so that neither the anti-joins
nor the lookups shuffle them. Keys are 96 bits of hash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pinned
from corpuslens.llm.common import GAPS, lowered, parts, scratch, text_of, unused
from corpuslens.operators.storage import materialised, remove_folder

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_OUT = 3
KEYS = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lowered(F.btrim(line, F.lit(GAPS)))


def _lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")]


@dataclass
class LineRuns:
    """The runs of one index; ``levels[i]`` are the names of the runs on level i."""

    spark: SparkSession
    fan_out: int = FAN_OUT
    levels: list[list[str]] = field(default_factory=list)
    logs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = parts(self.spark)
        self.folder = scratch(self.spark, "line-runs")
        self.made: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select(*KEYS, "docs", "last")
            .repartition(self.buckets, *KEYS)
            .write.bucketBy(self.buckets, *KEYS)
            .sortBy(*KEYS)
            .option("path", f"{self.folder}/{name}")
            .saveAsTable(name)
        )
        self.made.append(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, sightings: DataFrame) -> None:
        """Adds a batch: rows ``h1``, ``h2``, ``doc``, one for each document and key."""
        batch = sightings.groupBy(*KEYS).agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        if self.runs():
            counted = self.spark.table(self._write(batch))
            fresh = counted
            for name in self.runs():
                fresh = fresh.hint("merge").join(self.spark.table(name).select(*KEYS), KEYS, "left_anti")
            run = self._write(fresh)
            known = counted.hint("merge").join(self.spark.table(run).select(*KEYS), KEYS, "left_anti")
            self.logs.append(self._write(known))
        else:
            run = self._write(batch)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        """Merges full levels; runs share no key, so nothing is counted again."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_out:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._union(self.levels[level])))
                self.levels[level] = []
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        """Rows of several runs, read as plain files: a union of bucketed scans must not pass for bucketed."""
        schema = self.spark.table(names[0]).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    def totals(self) -> DataFrame:
        """Every key once with its number of documents and the largest one."""
        if not self.logs:
            return self._union(self.runs())
        later = (
            self._union(self.logs)
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        )
        stored = self.spark.table(self._write(later.select(*KEYS, F.col("more").alias("docs"), F.col("later").alias("last"))))
        stored = stored.select(*KEYS, F.col("docs").alias("more"), F.col("last").alias("later"))
        found = None
        for name in self.runs():
            run = self.spark.table(name).hint("merge").join(stored, KEYS, "left").select(
                *KEYS,
                (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"),
                F.greatest("last", "later").alias("last"),
            )
            found = run if found is None else found.unionByName(run)
        return found

    def close(self) -> None:
        """Takes the tables out of the catalog and their files out of the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made = []
        remove_folder(self.spark, self.folder)


def sightings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document row and distinct key: ``h1``, ``h2``, ``doc``; see :func:`once_each`."""
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    return (
        docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(keys)).alias("key"))
        .select(*_hashes(F.col("key")), "doc")
    )


def once_each(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """Sightings with each document once: rows that share an id, null too, are one document.

    Ids alone are looked through for repeats; only sightings of repeated ids are made distinct.
    """
    again = docs.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    if again.isEmpty():
        return seen
    same = F.col("doc").eqNullSafe(F.col("again"))
    return seen.join(again, same, "left_anti").unionByName(seen.join(again, same, "left_semi").distinct())


def repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """Keys found in ``min_docs`` documents or more, with the document that keeps them."""
    spark = docs.sparkSession
    seen = once_each(sightings(docs, min_chars), docs).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    stored = materialised(seen)
    runs = LineRuns(spark)
    try:
        for batch in range(batches):
            runs.add(stored.where(F.col("batch") == batch))
        return materialised(runs.totals().where(F.col("docs") >= min_docs).select(*KEYS, "last"))
    finally:
        runs.close()


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """All columns of ``docs`` and ``kept_text``, ``n_lines``, ``n_dropped``.

    Needs ``doc_id`` and ``text``; other columns are carried, except ones with
    the three added names, which are replaced. A null text is one empty line and
    stays so. Rows that share a ``doc_id`` count as one document; of a
    repeated line, the rows with the largest ``doc_id`` that holds it keep all
    of theirs. A null ``doc_id`` is below every other, all rows with it count as one
    document, and where all are null nothing is dropped. An empty table gives an empty result.
    """
    popular = repeated_lines(docs, min_chars, min_docs, batches)
    spread = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("body"),
        F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"),
    ).where(F.length("key") >= min_chars)
    dropped = (
        spread.select("doc", "body", "pos", *_hashes(F.col("key")))
        .join(popular, KEYS)
        .where(F.coalesce(F.col("doc") < F.col("last"), F.col("last").isNotNull()))
        .groupBy("doc", "body")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    own = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    docs = docs.select(*own)
    body, doc, gone, lines = unused(docs, "_body", "_doc", "_gone", "_lines")
    dropped = dropped.select(F.col("doc").alias(doc), F.col("body").alias("_side_body"), F.col("gone").alias(gone))
    rows = docs.withColumn(body, F.xxhash64("text")).join(
        dropped, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(body) == F.col("_side_body")), "left"
    )
    rows = pinned(rows.drop(doc, "_side_body", body), **{lines: _lines(F.col("text"))})
    # The stretches between dropped lines are cut out whole: linear in the lines.
    cuts = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(-1)), cuts)
    ends = F.concat(cuts, F.array(F.size(lines)))
    pieces = F.zip_with(
        starts, ends, lambda s, e: F.slice(F.col(lines), s + 2, F.greatest(e - s - 1, F.lit(0)))
    )
    return rows.select(
        *own,
        F.when(F.col(gone).isNull(), text_of(F.col("text"))).otherwise(F.array_join(F.flatten(pieces), "\n")).alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
