"""Chat formatting: reply trees to conversations in a marked template.

Messages form trees by ``parent``. Self-joins that double their reach find for
every message its root, its depth and the sum of scores on the way; leaves are
ranked by that sum, and for the chosen ones the same jumps, run downwards in
reach, list the path. Each path is one conversation of the template, in which
every turn is marked and control characters inside texts are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.arrays import pinned, running
from corpuslens.llm.common import text_of
from corpuslens.operators.storage import materialised

# The template: "### role: text</turn>\n" for each turn; a backslash goes before each of \ # < : inside.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
# Possessive repeats keep long texts off the matcher's stack.
TURN = r"(?s)### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<:]++|\\.)*+)</turn>\n"
KEY = ["conv", "node"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text_of(text), r"([\\#<:])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_chain(rows: DataFrame) -> DataFrame:
    """Conversations without replies to choose from, as trees of one branch.

    ``conv_id``, ``turn``, ``role``, ``text`` become ``conv``, ``node``,
    ``parent``, ``role``, ``text``, ``score``; rows of equal ``turn`` follow each
    other by role and text, null turns first. Repeated rows are turns of their own; a
    null ``conv_id`` is one conversation. An empty table gives an empty result.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("bigint"))
    return numbered.select(
        F.col("conv_id").alias("conv"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def unreached(messages: DataFrame) -> DataFrame:
    """The messages that no path reaches, with all columns: those on a circle of replies, or behind one.

    ``messages`` as for :func:`formatted`; null nodes are paths of their own and not among them.
    """
    arrived = _risen(messages.where(F.col("node").isNotNull()))[2].select(F.col("conv").alias("_c"), F.col("node").alias("_at"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_at"))
    return messages.where(F.col("node").isNotNull()).join(arrived, same, "left_anti")


# Null conversations are one conversation.
def _meets(a: str, b: str, at: tuple[str, str]) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(at[0]) == F.col(at[1]))


def _risen(messages: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Links, jumps by reach, and every message that has a root: with its root, depth and sum of scores."""
    links = materialised(messages.select(*KEY, "parent", F.coalesce("score", F.lit(0.0)).alias("score")).dropDuplicates(KEY))
    there = links.select(F.col("conv").alias("c"), F.col("node").alias("up"))
    jumps = materialised(
        links.join(there, _meets("conv", "c", ("parent", "up")), "left").select(
            *KEY, "up", F.col("score").alias("sum"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
            F.col("node").alias("root"),
        )
    )
    # What has arrived at its root is set aside; only what is still under way is joined again.
    moving, arrived = jumps.where("up is not null"), jumps.where("up is null")
    levels = [moving.select("conv", "node", "up")]
    rows = links.count()
    while 2 ** len(levels) <= 2 * rows and not levels[-1].isEmpty():
        far = moving.unionByName(arrived).select(
            F.col("conv").alias("c"), F.col("node").alias("at"), F.col("up").alias("next"), F.col("sum").alias("more"),
            F.col("depth").alias("deeper"), F.col("root").alias("top"),
        )
        moved = materialised(
            moving.join(far, _meets("conv", "c", ("up", "at"))).select(
                *KEY, F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum"),
                (F.col("depth") + F.col("deeper")).alias("depth"), F.col("top").alias("root"),
            )
        )
        moving, arrived = moved.where("up is not null"), arrived.unionByName(moved.where("up is null"))
        levels.append(moving.select("conv", "node", "up"))
    return links, levels, arrived


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Rows ``conv``, ``leaf``, ``node``, ``depth`` of the best root-to-leaf paths.

    For every root the ``branches`` leaves with the largest score sums are kept;
    ties go to the smaller leaf. A message whose parent is not there is a root;
    one on a circle of replies, or behind it, is reached by no path and given by
    :func:`unreached`. Rows without a node are left aside.
    """
    links, levels, arrived = _risen(messages.where(F.col("node").isNotNull()))
    leaves = arrived.join(
        links.select(F.col("conv").alias("c"), F.col("parent").alias("p")).where("p is not null").distinct(),
        _meets("conv", "c", ("node", "p")), "left_anti",
    )
    best = Window.partitionBy("conv", "root").orderBy(F.desc("sum"), "node")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches)
    paths = chosen.select("conv", F.col("node").alias("leaf"), "node", "depth")
    for reach in reversed(range(len(levels) - 1)):
        up = levels[reach].select(F.col("conv").alias("c"), F.col("node").alias("at"), "up")
        above = paths.join(up, _meets("conv", "c", ("node", "at"))).select(
            "conv", "leaf", F.col("up").alias("node"), (F.col("depth") - 2**reach).alias("depth")
        )
        paths = materialised(paths.unionByName(above))
    return paths


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One row for each chosen path: ``conv``, ``leaf``, ``formatted``, ``mask``.

    ``messages`` has ``conv``, ``node``, ``parent``, ``role``, ``text``,
    ``score``; other columns are not read. ``mask`` lists the spans (``start``,
    ``end``, code points) of assistant texts in the output. Null roles and texts
    are empty; of messages with one id the first by role and text counts. A message
    with a null node cannot be replied to: each is a conversation of its own, with a
    null ``leaf``. Messages on circles of replies come from :func:`unreached`. An
    empty table gives an empty result. A conversation is one string, so one path
    must fit a row.
    """
    own = Window.partitionBy(*KEY).orderBy("role", "text", "parent", "score")
    nameless = messages.where(F.col("node").isNull())
    messages = materialised(
        messages.where(F.col("node").isNotNull()).select(*KEY, "parent", "role", "text", "score")
        .withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
    )
    paths = chosen_paths(messages, branches)
    side = messages.select(F.col("conv").alias("c"), F.col("node").alias("at"), text_of(F.col("role")).alias("role"), "text")
    turn = F.struct(
        "depth", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)).alias("head"), escaped(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    )
    turns = paths.join(side, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("at"))).select("conv", "leaf", turn.alias("turn"))
    lists = turns.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    alone = nameless.select(
        "conv", F.col("node").alias("leaf"), F.lit(0).cast("bigint").alias("depth"), text_of(F.col("role")).alias("role"), "text"
    ).select("conv", "leaf", F.array(turn).alias("t"))
    lists = lists.unionByName(alone)
    # Where each turn begins: sums over the turns before it, in one pass over the path.
    lengths = F.transform("t", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).cast("bigint"))
    pinned_rows = pinned(
        pinned(lists, lengths=lengths),
        before=running(F.col("lengths"), F.lit(0).cast("bigint"), lambda s, n: s + n, lambda s, n: s, "bigint"),
    )
    start = lambda x, b: b + F.length(x["head"])
    spans = F.zip_with(
        "t", "before",
        lambda x, b: F.when(x["learn"], F.struct(start(x, b).alias("start"), (start(x, b) + F.length(x["body"])).alias("end"))),
    )
    return pinned_rows.select(
        "conv", "leaf",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.array_compact(spans).alias("mask"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """Turns and learned text out of formatted conversations: ``turns`` (role, text) and ``learned``.

    Null roles and texts come back empty, as they were written; a conversation without
    assistant turns has learned the empty text. An empty table gives an empty result.
    """
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    return output.select(
        "*",
        F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text"))).alias("turns"),
        F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "").alias("learned"),
    )
