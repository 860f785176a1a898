"""Code structure as columns of the file table. No step shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import structure as S
from corpuslens.functions.arrays import pinned


def _headers() -> Column:
    return S.extract_headers(F.col("stripped"))


def _all_brace_steps() -> Column:
    return S.brace_steps(F.col("stripped"))


def _brace_steps_of_types() -> Column:
    # Braces matter only where a type begins.
    return S.brace_steps(F.when(F.size("heads") > 0, F.col("stripped")).otherwise(""))


def _marks() -> Column:
    return S.brace_marks(F.col("_steps"))


def _pairs() -> Column:
    return S.brace_pairs(F.col("marks"))


def _head_steps() -> Column:
    return S.head_steps(F.col("stripped"))


def _heads() -> Column:
    return S.type_heads(F.col("_steps"))


def _heads_but_enums() -> Column:
    return S.exclude_enum(F.col("heads"))


def _entries() -> Column:
    return S.heads_and_braces(F.col("heads"), F.col("marks"), F.col("pairs"))


def _placed() -> Column:
    return S.placed_heads(F.col("_entries"))


def _closed() -> Column:
    return S.closed_bodies(F.col("_placed"))


def _loose() -> Column:
    return S.loose_heads(F.col("_placed"))


def _shared_steps() -> Column:
    return S.steps_from_first(F.col("stripped"), F.col("heads"))


def _shared_marks() -> Column:
    return S.shifted(F.col("marks"), F.col("heads"))


def _restarted_steps() -> Column:
    return S.restarted_steps(F.col("stripped"), F.col("heads"))


def _bodies() -> Column:
    left = S.bodies_in_literals(F.col("heads"), F.col("_steps"))
    return F.array_sort(F.concat(F.col("_in_code"), F.col("_shared"), left))


def _pieces() -> Column:
    return S.statement_pieces(F.col("stripped"), F.col("bodies"))


def _traces() -> Column:
    return S.statement_traces(F.col("bodies"), F.col("_pieces"))


def _classes() -> Column:
    return S.collect_classes(F.col("bodies"), F.col("traces"))


def with_stripped(files: DataFrame, text: str = "text") -> DataFrame:
    return pinned(files, stripped=S.strip_comments(F.col(text)))


def with_headers(files: DataFrame) -> DataFrame:
    return pinned(files, headers=_headers)


def with_braces(files: DataFrame) -> DataFrame:
    """Adds ``marks`` (braces outside literals) and ``pairs`` (matching braces)."""
    return pinned(files, _steps=_all_brace_steps, marks=_marks, pairs=_pairs).drop("_steps")


def with_heads(files: DataFrame) -> DataFrame:
    """Adds ``heads``: every class or struct head, enums still marked."""
    return pinned(files, _steps=_head_steps, heads=_heads).drop("_steps")


def with_bodies(files: DataFrame) -> DataFrame:
    """Adds ``bodies``: types that close, with the positions of their braces."""
    placed = pinned(
        with_heads(files),
        heads=_heads_but_enums,
        _steps=_brace_steps_of_types,
        marks=_marks,
        pairs=_pairs,
    )
    in_code = pinned(placed, _entries=_entries, _placed=_placed, _in_code=_closed, heads=_loose)
    # Heads in literals: one scan for all that share it, then one for each that is left.
    steps = pinned(in_code, _steps=_shared_steps, marks=_marks)
    shared = pinned(steps, marks=_shared_marks, pairs=_pairs, _entries=_entries, _placed=_placed, _shared=_closed, heads=_loose)
    bodies = pinned(shared, _steps=_restarted_steps, bodies=_bodies)
    return bodies.drop("_in_code", "_shared", "_entries", "_placed", "_steps", "marks", "pairs", "heads")


def with_traces(files: DataFrame) -> DataFrame:
    """Adds ``traces``: per type, one entry for every ``(){};`` of its body."""
    return pinned(with_bodies(files), _pieces=_pieces, traces=_traces).drop("_pieces")


def with_classes(files: DataFrame) -> DataFrame:
    return pinned(with_traces(files), classes=_classes).drop("bodies", "traces")


def with_structure(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``headers`` and ``classes`` to a table of file texts."""
    return with_classes(with_headers(with_stripped(files, text))).drop("stripped")
