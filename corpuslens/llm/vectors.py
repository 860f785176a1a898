"""Whole-number vectors in blocks that a task works on as one matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "dim int, block bigint, ids binary, tags binary, matrix binary"


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component, worked out as doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint"))


def usable(vector: Column, factor: int, dims: int | None = None) -> Column:
    """Whether a vector has the wanted size and only finite components, none null.

    Scaled components beyond ``sqrt(2**60 / size)`` are not usable either (2**27
    for 64 components): no product or distance of two vectors would be sure to fit
    a long.
    """
    size = F.size(vector)
    most = F.sqrt(F.lit(float(1 << 60)) / F.greatest(size, F.lit(1)))
    fine = lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * factor <= most), F.lit(False)
    )
    right = size == dims if dims is not None else size > 0
    return F.coalesce(vector.isNotNull() & right & F.forall(vector, fine), F.lit(False))


def in_blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """Rows ``id``, ``tag`` (longs) and ``v`` (longs) as blocks of ``per_block`` rows of one size each.

    A block's number says which task made it and in what order, so blocks must be
    written once before they are read twice.
    """

    def pack(dim: int, number: int, ids: list, tags: list, matrix: list) -> pa.RecordBatch:
        values = [[dim], [number]] + [[np.concatenate(x).tobytes()] for x in (ids, tags, matrix)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)],
            ["dim", "block", "ids", "tags", "matrix"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            for dim in np.unique(sizes).tolist():
                at = np.nonzero(sizes == dim)[0]
                matrix = flat[starts[at][:, None] + np.arange(dim)]
                own = held.setdefault(dim, ([], [], []))
                while len(at):
                    room = per_block - sum(map(len, own[0]))
                    for store, new in zip(own, (ids[at[:room]], tags[at[:room]], matrix[:room]), strict=True):
                        store.append(new)
                    at, matrix = at[room:], matrix[room:]
                    if sum(map(len, own[0])) == per_block:
                        yield pack(dim, number, *own)
                        number += 1
                        own = held[dim] = ([], [], [])
        for dim, own in held.items():
            if own[0]:
                yield pack(dim, number, *own)
                number += 1

    return rows.select("id", "tag", "v").mapInArrow(run, BLOCKS)


def unpacked(ids: bytes, tags: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64), np.frombuffer(matrix, np.int32).reshape(-1, dim)
