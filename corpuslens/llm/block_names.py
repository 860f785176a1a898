"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The different blocks are
sorted and take their places as integer names; adjacent names are then paired,
the different pairs are sorted and named in turn, until a text is down to one
name. A name stands for one stretch of bytes and no other, so texts are equal
exactly when they end on the same level with the same name.

A text's bytes are shuffled once, to find the different blocks, and equal blocks
are put together before that. Names come back to their texts by a block's hash,
which is only used once it is shown to tell all blocks of the table apart; if two
share one, the next seed is taken. Each level has half the rows of the one below.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pinned
from corpuslens.llm.common import Steps, text_of

BLOCK_BYTES = 1024
ADDED = ("keep_id", "group_size", "kept", "identity")


def _blocks(docs: DataFrame, text: str, block_bytes: int, kept: list[Column]) -> DataFrame:
    """``kept`` and ``_blocks``, the text's bytes in blocks; an empty text is one empty block."""
    rows = pinned(docs.select(*kept, text_of(F.col(text)).cast("binary").alias("_body")), _body=F.col("_body"))
    last = F.greatest(F.ceil(F.octet_length("_body") / block_bytes).cast("int"), F.lit(1)) - 1
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_body"), i * block_bytes + 1, F.lit(block_bytes))
    )
    return rows.select(*[c for c in rows.columns if c != "_body"], cut.alias("_blocks"))


def _prints(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("h1"), F.hash(F.lit(seed), block).alias("h2")]


def _numbered(different: DataFrame, order: list[str], kept: list[Column]) -> DataFrame:
    """``kept`` and ``name``: each row's place among the sorted rows of its hash partition.

    The rows are all different, so a task that is run again gives the same names.
    """
    return different.sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("name"))


def _named_blocks(docs: DataFrame, text: str, block_bytes: int, steps: Steps, seeds: Iterator[int]) -> tuple[DataFrame, int]:
    """Names of all blocks by their hashes ``h1``, ``h2``, and the seed under which no two blocks share them."""
    while True:
        seed = next(seeds)
        different = _blocks(docs, text, block_bytes, []).select(F.explode("_blocks").alias("block")).distinct()
        names = steps.write("names", _numbered(different, ["block"], _prints(F.col("block"), seed)))
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            return names, seed


def exact_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    with_text: bool = False,
    seeds: Iterator[int] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: its columns but the text, and which row of equal texts stays.

    Adds ``keep_id`` (the id of the row that stays), ``group_size``, ``kept`` and
    ``identity`` (level and name); columns of these names are replaced. With
    ``with_text`` the text is handed on as well. A null text is an empty one, and
    all empty texts are equal. The row with the largest id stays; a null id is
    below every other, and of rows that tie in id one stays. Rows that repeat
    count each. A very long text is many blocks and no task holds them all but
    where the text itself is read. An empty table gives an empty result. ``docs``
    is read twice and must hold the same rows both times.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "block-names")
    own = [c for c in docs.columns if c.lower() not in ADDED and (with_text or c != text)]
    names, seed = _named_blocks(docs, text, block_bytes, steps, seeds or count())
    carried = [F.struct(*own).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("_text")]
    rows = _blocks(docs.select(*carried), "_text", block_bytes, [F.col("row"), F.col("id"), F.col("_text")])
    prints = F.transform("_blocks", lambda b: F.struct(*_prints(b, seed)))
    rows = steps.write("rows", rows.select(F.monotonically_increasing_id().alias("rid"), "row", "id", prints.alias("prints")))
    spread = rows.select("rid", F.size("prints").alias("n"), F.posexplode("prints").alias("pos", "print"))
    spread = spread.select("rid", "n", "pos", "print.h1", "print.h2")
    level = steps.write("level-0", spread.join(names, ["h1", "h2"]).select("rid", "n", "pos", "name"))
    steps.drop("names")
    most = level.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("rid", F.lit(depth).alias("level"), "name"))
        if most == 1:
            break
        depth, most = depth + 1, (most + 1) // 2
        level = _next_level(level, depth, steps)
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    found = steps.write("found", rows.select("rid", "row", "id").join(ends, "rid"))
    steps.drop("rows", *[f"level-{d}" for d in range(depth + 1)])
    groups = found.groupBy("level", "name").agg(
        F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("group_size")
    )
    return found.join(groups, ["level", "name"]).select(
        "row.*",
        F.col("top.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        F.struct("level", "name").alias("identity"),
    )


def _next_level(level: DataFrame, depth: int, steps: Steps) -> DataFrame:
    """Adjacent names of unfinished texts, paired and named; the last of an odd number is paired with nothing."""
    side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
    pairs = steps.write(
        "pairs",
        level.where("n > 1")
        .groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("at"))
        .agg(F.max("n").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")),
    )
    names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], [F.col("a"), F.col("b")])
    half = F.floor((F.col("n") + 1) / 2).cast("int").alias("n")
    named = pairs.join(names, ["a", "b"]).select("rid", half, F.col("at").alias("pos"), "name")
    return steps.write(f"level-{depth}", named)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all columns; see :func:`exact_duplicates` for nulls, ties and repeats.

    Columns named like the added ones come back as they were.
    """
    boxed = docs.select(F.struct(*docs.columns).alias("whole"), F.col(doc_id).alias("id"), F.col(text).alias("body"))
    return exact_duplicates(boxed, "body", "id").where("kept").select("whole.*")
