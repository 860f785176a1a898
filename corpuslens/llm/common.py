"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import ascii_lower
from corpuslens.operators.storage import materialised, remove_folder, shared_folder

# The characters that part words and that a line is stripped of.
GAPS = "\x20\x09\x0a\x0b\x0c\x0d"
GAP_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Steps:
    """Tables that one job writes to the shared storage, each removed once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, scratch(spark, name), {}

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as a table; a second one of the same name takes the place of the first."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_folder(self.spark, self.paths.pop(name))


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; a text of ASCII alone takes the quicker ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text_of(text), GAP_CLASS + "+"), lambda w: w != "")


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of the table's own, whatever those are."""
    taken = {c.lower() for c in rows.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chi_square(share: float, freedom: int) -> float:
    """The chi-square quantile by the Wilson-Hilferty cube."""
    from statistics import NormalDist

    spread = 2.0 / (9.0 * freedom)
    return freedom * (1.0 - spread + NormalDist().inv_cdf(share) * math.sqrt(spread)) ** 3


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links ``a``, ``b``: rows ``node``, ``root``.

    Stars are grown in turns: every node hands its larger neighbours to its
    smallest one, then its smaller ones; the links shrink to one star for each
    component, in a number of rounds that is logarithmic in practice. Every
    round is a written table, so a lost executor costs one round. A node with
    very many links is an aggregate that combines before the shuffle, and the
    join on it is one that Spark can split. Nodes without links are not listed;
    ``root`` is the smallest node. Null ends are left out.
    """
    edges = materialised(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialised(
            both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = materialised(small.where("a <> b").distinct())
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
