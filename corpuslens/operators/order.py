"""Path order and dense positions without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.paths import path_order
from corpuslens.operators.storage import materialised


def sort_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Part-by-part path order as a global range-partitioned sort."""
    return files.orderBy(path_order(F.col(path)))


# A group up to this size is one window in one task; larger ones are cut into blocks.
GROUP_ROWS = 1_000_000


def is_small(rows: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than ``GROUP_ROWS`` rows: counts that combine before the shuffle."""
    if not keys:
        return False
    return rows.groupBy(*keys).count().where(F.col("count") > GROUP_ROWS).isEmpty()


def _in_blocks(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by group and order and written once.

    A ``_block`` is one bounded slice of the sorted rows whatever the group sizes are.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k) for k in keys] + list(order)
    return materialised(rows.repartitionByRange(blocks, *sort).withColumn("_block", F.spark_partition_id()))


def _with_starts(cut: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Adds ``_start``: the sum of ``size`` over a group's earlier blocks. Null keys are a group."""
    # One row per group and block: a group adds no more than one row per block.
    sizes = cut.groupBy(*keys, "_block").agg(size.alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_of{i}" for i in range(len(keys) + 1)]
    starts = sizes.select(
        *[F.col(k).alias(n) for k, n in zip([*keys, "_block"], names, strict=True)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_block"], names, strict=True)]
    return cut.join(starts, reduce(lambda a, b: a & b, same)).drop(*names)


def with_positions(
    rows: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "pos"
) -> DataFrame:
    """Adds the 0-based place of each row within its group.

    Where all groups are small a window numbers them. Else block counts give each
    block its start, and ranks inside a block are a small window. Pass narrow rows:
    they are read twice, and shuffled twice in blocks.
    """
    keys = list(group or [])
    if is_small(rows, keys):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return rows.withColumn(name, place.cast("bigint"))
    started = _with_starts(_in_blocks(rows, keys, order), keys, F.count("*"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return started.withColumn(
        name, (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint")
    ).drop("_block", "_start")


def running_sum(rows: DataFrame, order: list[str], group: list[str], value: str, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` over a group's rows up to and with each row.

    ``order`` must tell a group's rows apart. Works in windows or blocks like
    :func:`with_positions`.
    """
    if is_small(rows, group):
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(upto))
    started = _with_starts(_in_blocks(rows, group, [F.col(c) for c in order]), group, F.sum(value))
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return started.withColumn(name, F.col("_start") + F.sum(value).over(inside)).drop("_block", "_start")
