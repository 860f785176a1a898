"""Small array helpers the built-in functions lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named twice inside a higher-order function is also computed
    twice; binding it to a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_built: dict[Callable[[], Column], tuple[SparkContext, Column]] = {}


def _once(rows: DataFrame, build: Callable[[], Column]) -> Column:
    """Builds a long expression once per Spark context instead of once per use.

    Each part of an expression is a call into the JVM, which would add seconds
    to every micro-batch of a stream.
    """
    context = rows.sparkSession.sparkContext
    made_for, column = _built.get(build, (None, None))
    if made_for is not context:
        column = build()
        _built[build] = (context, column)
    return column


def pinned(rows: DataFrame, **values: Column | Callable[[], Column]) -> DataFrame:
    """Adds columns one after the other, each worked out once per row.

    Catalyst copies a column's expression into every later filter and into
    projections that name it once, lambdas included. For the long expressions
    here that multiplies the work, so each is put behind the explode of a
    one-element array, which nothing is moved across. A module-level function in
    place of a column is called once per Spark context.
    """
    for name, value in values.items():
        column = value if isinstance(value, Column) else _once(rows, value)
        kept = [F.col(c) for c in rows.columns if c != name]
        rows = rows.select(*kept, F.explode(F.array(column)).alias(name))
    return rows


def running(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    emit_type: str,
) -> Column:
    """Left-to-right scan of an array inside one row, without a shuffle.

    ``emit(state_before, item)`` is collected for every item while ``step``
    moves the state on. ``aggregate`` copies its whole state at every item, so
    collecting n results in it costs n squared. Here one pass keeps only the
    state at the start of every block and a second pass collects each block on
    its own; with blocks of about the cube root of 2n both stay small.

    ``items`` is named several times: pass a column or a lambda variable, not a
    costly expression.
    """
    nothing = F.array().cast(f"array<{emit_type}>")
    width = F.greatest(F.lit(16), F.cbrt(F.size(items) * 2).cast("int"))
    last = F.greatest(F.ceil(F.size(items) / width).cast("int") - 1, F.lit(0))

    def block(i: Column) -> Column:
        return F.slice(items, i * width + 1, width)

    numbers = F.sequence(F.lit(0), last)
    starts = F.aggregate(
        F.slice(numbers, F.lit(1), last),
        F.array(zero),
        lambda states, i: F.array_append(
            states, F.aggregate(block(i), F.element_at(states, -1), step)
        ),
    )

    def collect(i: Column, start: Column) -> Column:
        return F.aggregate(
            block(i),
            F.struct(start.alias("s"), nothing.alias("out")),
            lambda acc, x: F.struct(
                step(acc["s"], x).alias("s"),
                F.array_append(acc["out"], emit(acc["s"], x)).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.flatten(F.zip_with(numbers, starts, collect))
