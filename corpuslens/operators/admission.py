"""Rate windows, request schedules and run cooldowns over request logs.

Request times are integer microseconds. A busy key is cut into time slices, so
no task has to hold one key's whole history.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.order import is_small, running_sum, with_positions
from corpuslens.operators.storage import materialised

MINUTE_US = 60_000_000


def _slice_of(t: Column, width: int) -> Column:
    """Number of the time slice, whole also for times before the epoch."""
    return ((t - F.pmod(t, F.lit(width))) / width).cast("bigint")


def rate_window_count(log: DataFrame, window_us: int = MINUTE_US) -> DataFrame:
    """Adds ``in_window``: requests of the same key in (t - window, t].

    A request adds one at its time and takes it back a window later, so the count is
    a running sum in time. Where no key has more than a million requests that is one
    window per key. Else instants are summed up before the shuffle and the sum runs
    in blocks, so a busy key or window is no larger than others. Null keys are a key;
    a null time has a null count and counts for none; repeated rows count each.
    """
    log = log.drop("in_window")
    timed = F.col("t").isNotNull()
    if is_small(log, ["key"]):
        back = log.select(
            *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("key", "t") else F.col(f.name) for f in log.schema]
        ).where(timed).withColumn("t", F.col("t") + window_us)
        steps = log.withColumn("_n", timed.cast("bigint")).unionByName(back.withColumn("_n", F.lit(-1).cast("bigint")))
        upto = Window.partitionBy("key").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
        counted = steps.withColumn("in_window", F.when(timed, F.sum("_n").over(upto)))
        return counted.where(F.col("_n") >= 0).drop("_n")
    step = lambda t, n: F.struct(t.alias("_t"), F.lit(n).alias("_n"))
    steps = (
        log.where(timed)
        .select(
            F.col("key").alias("_key"),
            F.inline(F.array(step(F.col("t"), 1), step(F.col("t") + window_us, -1))),
        )
        .groupBy("_key", "_t")
        .agg(F.sum("_n").alias("_change"))
    )
    counts = running_sum(steps, ["_t"], ["_key"], "_change", "in_window").drop("_change")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t"))
    return log.join(counts, same, "left").drop("_key", "_t")


RUN_LENGTH = 4096


def admission_schedule(log: DataFrame, limit: int, window_us: int = MINUTE_US) -> DataFrame:
    """Adds ``admit``: the earliest first-in-first-out send time per request.

    A request waits until ``limit`` places earlier is a window old:
    ``admit(i) = max(t(i), admit(i - limit) + window)``. With i = limit * j + c
    this is ``window * j`` plus the running maximum of ``t - window * j``
    along j. The runs are cut every 4,096 places and joined by their maxima. Places come
    from range-partitioned blocks, so a burst of one key is shared out.
    """
    ranked = with_positions(log, [F.col("t"), F.col("id")], ["key"], "rn")
    placed = (
        ranked.withColumn("_c", F.col("rn") % limit)
        .withColumn("_j", F.floor(F.col("rn") / limit).cast("bigint"))
        .withColumn("_run", F.floor(F.col("_j") / RUN_LENGTH).cast("bigint"))
        .withColumn("_lead", F.col("t") - F.col("_j") * window_us)
    )
    earlier = Window.partitionBy("key", "_c").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("key", "_c", "_run")
        .agg(F.max("_lead").alias("_top"))
        .select(
            F.col("key").alias("_of"), F.col("_c").alias("_at"), F.col("_run").alias("_nth"),
            F.max("_top").over(earlier).alias("_before"),
        )
    )
    same = F.col("key").eqNullSafe(F.col("_of")) & (F.col("_c") == F.col("_at")) & (F.col("_run") == F.col("_nth"))
    along = Window.partitionBy("key", "_c", "_run").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_here", F.max("_lead").over(along))
        .join(before, same)
        .withColumn("admit", F.when(F.col("t").isNotNull(), F.greatest("_here", "_before") + F.col("_j") * window_us))
        .drop("rn", "_c", "_j", "_run", "_lead", "_here", "_before", "_of", "_at", "_nth")
    )


INTERVALS_PER_SLICE = 64
# Neighbouring tables that one task puts together.
TABLES_PER_BLOCK = 64
# Later than any entry.
ALWAYS = 1 << 62


def _slice_exits(times: list[int], first_end: int, interval: int) -> list[tuple[int, int]]:
    """Per group of entries with one outcome: its last entry and the slice's last accepted time."""
    after = np.searchsorted(times, np.asarray(times) + interval)
    out = list(times)
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            out[i] = out[after[i]]
    rows: list[tuple[int, int]] = []
    for t, exit_time in zip(times, out, strict=True):
        if rows and rows[-1][1] == exit_time:
            rows.pop()
        rows.append((t, exit_time))
        if t >= first_end:
            break
    return rows


def _accepted(times: list[int], last: int | None, interval: int) -> list[int]:
    picked = []
    for t in times:
        if last is None or t - last >= interval:
            picked.append(t)
            last = t
    return picked


def _through(upto: list[int], leave: list[int], last: int | None, interval: int) -> int | None:
    """The last accepted time behind a stretch that is entered with ``last``."""
    entry = 0 if last is None else int(np.searchsorted(upto, last + interval))
    return int(leave[entry]) if entry < len(upto) else last


def _composed(tables: list[dict], interval: int) -> tuple[list[int], list[int]]:
    """The table of several neighbouring stretches.

    Who passes the first stretch without a run enters the second at its first
    event, as an interval is over by then.
    """

    def behind(last: int | None) -> int | None:
        for table in tables[1:]:
            last = _through(table["upto"], table["exit"], last, interval)
        return last

    entries = list(zip(tables[0]["upto"], [behind(int(t)) for t in tables[0]["exit"]], strict=True))
    if len(tables) > 1 and entries[-1][0] != ALWAYS:
        entries.append((ALWAYS, behind(None)))
    kept = [e for e, after in zip(entries, [*entries[1:], None], strict=True) if after is None or after[1] != e[1]]
    return [int(upto) for upto, _ in kept], [leave for _, leave in kept]


# More instants than this in one slice, and a key goes by jumps instead of tables.
DENSE_SLICE = 100_000


def _next_instants(instants: DataFrame, interval: int) -> DataFrame:
    """Each instant's place and that of the first one an interval later: ``_key, t, pos, next``.

    An as-of join as a running count: the instants before a time are as many as the
    place of the first one at or after it. Runs in blocks for a busy key.
    """
    placed = materialised(with_positions(instants.select("_key", "t"), [F.col("t")], ["_key"]))
    asked = placed.select("_key", (F.col("t") + interval).alias("_at"), F.lit(0).alias("_is"), "t", "pos")
    there = placed.select("_key", F.col("t").alias("_at"), F.lit(1).alias("_is"), "t", "pos")
    counted = running_sum(asked.unionByName(there), ["_at", "_is", "pos"], ["_key"], "_is", "next")
    return counted.where(F.col("_is") == 0).select("_key", "t", "pos", "next")


def _accepted_by_jumps(instants: DataFrame, interval: int) -> DataFrame:
    """Accepted instants ``_key, t``: what a key's first instant reaches by jumps that double.

    After round k the marked places are those of the first ``2 ** k`` accepted runs,
    and a jump passes ``2 ** k`` of them. Every row is hashed by its place, so that
    no task holds a key; the rounds are the logarithm of the accepted runs.
    """
    steps = materialised(_next_instants(instants, interval))
    jumps = steps.select("_key", "pos", "next")
    marked = [steps.where(F.col("pos") == 0).select("_key", "pos")]
    while True:
        so_far = reduce(DataFrame.unionByName, marked)
        reached = materialised(
            so_far.join(jumps, ["_key", "pos"]).select("_key", F.col("next").alias("pos"))
            .join(steps.select("_key", "pos"), ["_key", "pos"])
        )
        if reached.isEmpty():
            return so_far.join(steps, ["_key", "pos"]).select("_key", "t")
        marked.append(reached)
        onward = jumps.select("_key", F.col("pos").alias("next"), F.col("next").alias("_then"))
        jumps = materialised(jumps.join(onward, ["_key", "next"]).select("_key", "pos", F.col("_then").alias("next")))


def cooldown_gate(log: DataFrame, interval_us: int) -> DataFrame:
    """Adds ``accepted``: at least an interval since the last accepted run.

    The choice is greedy in time, so a key is cut into slices of 64 intervals
    that are worked on at once. A slice can only be entered by an event of its
    first interval or the one after that; for each such entry the last accepted
    time of the slice is worked out, and entries with the same outcome are
    merged. Tables of neighbouring slices are put together in blocks of 64, level
    by level, until a key has one block; walking down again gives each slice its
    starting point, and each slice then marks its own events. A task holds the
    different instants of one slice, or 64 short tables. Keys with a slice of more
    than 100,000 instants go by doubling jumps instead, where no task holds a slice.

    Of several runs of a key at one instant the one with the smallest id is accepted;
    rows equal in key, time and id are one run and share the outcome. Null keys are a
    key; a run without a time is not accepted; a null id is above all others.
    """
    # A key as text, so that nulls and numbers pass through Python tasks unchanged.
    name = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("n"))
    timed = log.where(F.col("t").isNotNull()).select(name.alias("_key"), "t", "id")
    first = timed.groupBy("_key", "t").agg(F.min("id").alias("_id"))
    width = interval_us * INTERVALS_PER_SLICE
    busy = timed.groupBy("_key", _slice_of(F.col("t"), width).alias("slice")).count()
    dense = busy.where(F.col("count") > DENSE_SLICE).select("_key").distinct()
    if dense.isEmpty():
        picked = _accepted_by_slices(first.select("_key", "t"), interval_us)
    else:
        dense, instants = materialised(dense), materialised(first.select("_key", "t"))
        picked = _accepted_by_slices(instants.join(dense, "_key", "left_anti"), interval_us).unionByName(
            _accepted_by_jumps(instants.join(dense, "_key", "left_semi"), interval_us)
        )
    chosen = picked.join(first, ["_key", "t"]).select(
        F.col("_key").alias("_of"), F.col("t").alias("_at"), "_id", F.lit(True).alias("_picked")
    )
    same = (F.col("_key") == F.col("_of")) & (F.col("t") == F.col("_at")) & F.col("id").eqNullSafe(F.col("_id"))
    return (
        log.drop("accepted").withColumn("_key", name).join(chosen, same, "left")
        .withColumn("accepted", F.coalesce("_picked", F.lit(False)))
        .drop("_key", "_of", "_at", "_id", "_picked")
    )


def _accepted_by_slices(instants: DataFrame, interval_us: int) -> DataFrame:
    """Accepted instants ``_key, t`` by tables of slices; see :func:`cooldown_gate`."""
    width = interval_us * INTERVALS_PER_SLICE
    slices = (
        instants.select(F.col("_key").alias("key"), "t")
        .groupBy("key", _slice_of(F.col("t"), width).alias("slice"))
        .agg(F.array_sort(F.collect_list("t")).alias("times"))
    )

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables = [
                _slice_exits([int(t) for t in times], number * width + interval_us, interval_us)
                for number, times in zip(batch["slice"], batch["times"], strict=True)
            ]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "n": batch["slice"],
                    "upto": [[row[0] for row in table] for table in tables],
                    "exit": [[row[1] for row in table] for table in tables],
                }
            )

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_composed(list(tables), interval_us) for tables in batch["tables"]]
            yield pd.DataFrame(
                {"key": batch["key"], "n": batch["block"], "upto": [m[0] for m in made], "exit": [m[1] for m in made]}
            )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, tables, last in zip(batch["key"], batch["tables"], batch["last"], strict=True):
                last = None if pd.isna(last) else int(last)
                for table in tables:
                    rows.append((key, table["n"], last))
                    last = _through(table["upto"], table["exit"], last, interval_us)
            yield pd.DataFrame(rows, columns=["key", "n", "last"]).astype({"last": "Int64"})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lasts = [None if pd.isna(last) else int(last) for last in batch["last"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "times": [
                        _accepted([int(t) for t in times], last, interval_us)
                        for times, last in zip(batch["times"], lasts, strict=True)
                    ],
                }
            )

    table_type = "key string, n bigint, upto array<bigint>, exit array<bigint>"
    start_type = "key string, n bigint, last bigint"
    in_order = F.array_sort(F.collect_list(F.struct("n", "upto", "exit"))).alias("tables")

    def blocks(tables: DataFrame) -> DataFrame:
        return tables.groupBy("key", _slice_of(F.col("n"), TABLES_PER_BLOCK).alias("block")).agg(in_order)

    levels = [materialised(slices.mapInPandas(exits, table_type))]
    while not levels[-1].groupBy("key").count().filter(F.col("count") > TABLES_PER_BLOCK).isEmpty():
        levels.append(materialised(blocks(levels[-1]).mapInPandas(compose, table_type)))
    starts = (
        levels[-1].groupBy("key").agg(in_order)
        .withColumn("last", F.lit(None).cast("bigint"))
        .mapInPandas(walk, start_type)
    )
    for level in reversed(levels[:-1]):
        above = starts.withColumnRenamed("n", "block")
        starts = blocks(level).join(above, ["key", "block"]).select("key", "tables", "last").mapInPandas(walk, start_type)
    starts = starts.withColumnRenamed("n", "slice")
    return (
        slices.join(starts, ["key", "slice"])
        .select("key", "times", "last")
        .mapInPandas(mark, "key string, times array<bigint>")
        .select(F.col("key").alias("_key"), F.explode("times").alias("t"))
    )
