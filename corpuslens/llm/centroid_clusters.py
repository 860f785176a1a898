"""Centroid clustering with heap-ordered bounds.

Each block of vectors keeps one heap for each cluster. A vector's key is the gap
between the distance to its second nearest and to its nearest centroid, as they
were when it was last scanned, plus the drift its cluster had gathered by then:
its own centroid's moves and the largest move of any other. As long as the key is
above the cluster's drift of now, no other centroid can have come nearer. So a
round pops the vectors whose gap has expired from the top of each heap, scans just
those against all centroids, and leaves the others untouched; a heap whose top
still holds is not even unpacked.

Vectors lie in a bucketed table that is written once. The heaps are a narrow table
in the same buckets, written anew each round, so that no round shuffles vectors.
What a round's vectors add to and take from their clusters is summed up by Spark;
the centroids, their drifts and sums are what the driver holds.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import parts, scratch
from corpuslens.llm.vectors import in_blocks, scaled, unpacked, usable
from corpuslens.operators.storage import remove_folder

VECTORS_PER_BLOCK = 4096
# Keys are doubles: a vector this near its cluster's drift is scanned too.
SLACK = 1e-6
HEAPS = "block bigint, nearest binary, sizes array<int>, gaps binary, members binary, popped bigint, change array<bigint>"
ASSIGNED = "id bigint, known bigint, cluster int, distance bigint"


def _distances(matrix: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of each line to each centroid."""
    out = np.empty((len(matrix), len(centers)), np.int64)
    wide = matrix.astype(np.int64)
    for j, center in enumerate(centers):
        away = wide - center
        out[:, j] = np.einsum("ij,ij->i", away, away)
    return out


def _scan(matrix: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, ties by smaller number, and a gap that is sure not to be too large."""
    found = _distances(matrix, centers)
    nearest = found.argmin(axis=1)
    if len(centers) == 1:
        return nearest, np.full(len(matrix), np.inf)
    two = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
    return nearest, two[:, 1] * (1 - 1e-12) - two[:, 0] * (1 + 1e-12)


class BlockHeaps:
    """The heaps of one block: for each cluster pairs of key and member, smallest key on top."""

    def __init__(self, nearest: np.ndarray, sizes: list[int], gaps: np.ndarray, members: np.ndarray):
        self.nearest, self.gaps, self.members = nearest, gaps, members
        self.starts = [0, *np.cumsum(sizes).tolist()]
        self.opened: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, row: dict, k: int) -> BlockHeaps:
        if row["sizes"] is None:
            return cls(np.full(len(row["ids"]) // 8, -1, np.int32), [0] * k, np.zeros(0), np.zeros(0, np.int32))
        return cls(
            np.frombuffer(row["nearest"], np.int32).copy(), row["sizes"],
            np.frombuffer(row["gaps"], np.float64), np.frombuffer(row["members"], np.int32),
        )

    def _heap(self, c: int) -> list[tuple[float, int]]:
        if c not in self.opened:
            own = slice(self.starts[c], self.starts[c + 1])
            self.opened[c] = list(zip(self.gaps[own].tolist(), self.members[own].tolist(), strict=True))
        return self.opened[c]

    def expired(self, drift: list[float]) -> list[int]:
        """Pops the members whose key their cluster's drift has reached."""
        out = []
        for c, gone in enumerate(drift):
            edge = gone + SLACK * (1 + gone)
            if self.starts[c] < self.starts[c + 1] and self.gaps[self.starts[c]] <= edge:
                heap = self._heap(c)
                while heap and heap[0][0] <= edge:
                    out.append(heapq.heappop(heap)[1])
        return out

    def push(self, members: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for c in np.unique(clusters).tolist():
            new = list(zip(keys[clusters == c].tolist(), members[clusters == c].tolist(), strict=True))
            heap = self._heap(c)
            if len(new) * 8 > len(heap):
                heap.extend(new)
                heapq.heapify(heap)
            else:
                for entry in new:
                    heapq.heappush(heap, entry)

    def packed(self) -> dict:
        sizes, gaps, members = [], [], []
        for c in range(len(self.starts) - 1):
            if c in self.opened:
                heap = self.opened[c]
                gaps.append(np.array([e[0] for e in heap], np.float64))
                members.append(np.array([e[1] for e in heap], np.int32))
            else:
                own = slice(self.starts[c], self.starts[c + 1])
                gaps.append(self.gaps[own])
                members.append(self.members[own])
            sizes.append(len(gaps[-1]))
        return {
            "nearest": self.nearest.astype(np.int32).tobytes(), "sizes": sizes,
            "gaps": np.concatenate(gaps).tobytes(), "members": np.concatenate(members).astype(np.int32).tobytes(),
        }


def _round(row: dict, centers: np.ndarray, drift: list[float]) -> tuple[BlockHeaps, int, np.ndarray | None, np.ndarray]:
    """Rescans a block's expired vectors: its heaps, how many they were, and the change of sums and counts."""
    _, _, matrix = unpacked(row["ids"], row["tags"], row["matrix"], row["dim"])
    heaps = BlockHeaps.of(row, len(centers))
    popped = np.arange(len(matrix)) if row["sizes"] is None else np.array(sorted(heaps.expired(drift)), np.int64)
    if not len(popped):
        return heaps, 0, None, matrix
    nearest, gap = _scan(matrix[popped], centers)
    before = heaps.nearest[popped]
    heaps.nearest[popped] = nearest
    heaps.push(popped, nearest, gap + np.asarray(drift)[nearest])
    moved = np.nonzero(before != nearest)[0]
    if not len(moved):
        return heaps, len(popped), None, matrix
    change = np.zeros((len(centers), matrix.shape[1] + 1), np.int64)
    lines = np.hstack([matrix[popped[moved]].astype(np.int64), np.ones((len(moved), 1), np.int64)])
    np.add.at(change, nearest[moved], lines)
    left = before[moved] >= 0
    np.subtract.at(change, before[moved][left], lines[left])
    return heaps, len(popped), change, matrix


def starting_centers(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id; null ids come last, repeats of an id by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(F.desc("tag"), order, "v").limit(k)
    return [list(r["v"]) for r in first.select("v").collect()]


class Buckets:
    """Tables with the same buckets over ``block``, so that they join without a shuffle."""

    def __init__(self, spark):
        self.spark, self.number, self.folder, self.names = spark, parts(spark), scratch(spark, "clusters"), {}

    def write(self, kind: str, rows: DataFrame) -> DataFrame:
        name = f"clusters_{kind}_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        writer = rows.write.bucketBy(self.number, "block").sortBy("block").option("path", path)
        writer.saveAsTable(name)
        before = self.names.get(kind)
        self.names[kind] = (name, path)
        if before:
            self._drop(*before)
        return self.spark.table(name)

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, path)

    def close(self) -> None:
        for name, path in self.names.values():
            self._drop(name, path)


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    fields = [part.split(" ") for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields, strict=True)], [f[0] for f in fields])


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: str = "3",
    factor: int = 1024,
    dims: int = 64,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """Rows ``vec_id``, ``cluster``, ``distance``; the final centroids; how many vectors each round scanned.

    Components are ``floor(factor * x)`` and all sums exact. Each of ``rounds``
    assigns every vector to its nearest centroid (squared Euclidean distance, ties
    by smaller number) and then moves every centroid to the floor of its vectors'
    mean; a centroid without vectors stays. Then all are assigned once more.
    Vectors that :func:`corpuslens.llm.vectors.usable` turns down (null, of another
    size, with null, non-finite or very large components) take no part. A null id
    is kept and no start while there are others; repeated rows count each. With
    fewer vectors than ``k`` there are as many clusters as vectors; an empty table
    gives no rows and no centroids. Other columns are left aside.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector), factor, dims)).select(
        F.coalesce(F.col(vec_id).cast("bigint"), F.lit(0)).alias("id"),
        F.col(vec_id).isNotNull().cast("bigint").alias("tag"),
        scaled(F.col(vector), factor).alias("v"),
    )
    centers = np.array(starting_centers(rows, k, seed), np.int64).reshape(-1, dims)
    nothing = spark.createDataFrame([], f"{vec_id} bigint, cluster int, distance bigint")
    if not len(centers):
        return nothing, [], []
    k, tables, scanned = len(centers), Buckets(spark), []
    try:
        blocks = tables.write("vectors", in_blocks(rows, VECTORS_PER_BLOCK).repartition(tables.number, "block"))
        unknown = {"nearest": "binary", "sizes": "array<int>", "gaps": "binary", "members": "binary"}
        joined = blocks.withColumns({name: F.lit(None).cast(kind) for name, kind in unknown.items()})
        drift, totals = [0.0] * k, np.zeros((k, dims + 1), object)

        def step(at: np.ndarray, gone: list[float]):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        heaps, popped, change, _ = _round(row, at, gone)
                        kept = heaps.packed()
                        flat = None if change is None else change.ravel().tolist()
                        yield _arrow(HEAPS, [(row["block"], kept["nearest"], kept["sizes"], kept["gaps"], kept["members"], popped, flat)])

            return run

        for _ in range(rounds):
            heaps = tables.write("heaps", joined.mapInArrow(step(centers, list(drift)), HEAPS))
            scanned.append(heaps.agg(F.sum("popped")).first()[0] or 0)
            for place, change in heaps.select(F.posexplode("change")).groupBy("pos").agg(F.sum("col")).collect():
                totals[divmod(place, dims + 1)] += change
            moved = np.array([
                [int(s) // int(line[-1]) for s in line[:-1]] if line[-1] else center
                for line, center in zip(totals, centers.tolist(), strict=True)
            ], np.int64)
            steps = [math.sqrt(sum(d * d for d in line)) * (1 + 1e-12) for line in (moved - centers).tolist()]
            drift = [
                gone + own + max([s for j, s in enumerate(steps) if j != c], default=0.0)
                for c, (gone, own) in enumerate(zip(drift, steps, strict=True))
            ]
            centers = moved
            joined = blocks.hint("merge").join(heaps.drop("popped", "change"), "block")

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    heaps, _, _, matrix = _round(row, centers, drift)
                    ids, tags, _ = unpacked(row["ids"], row["tags"], row["matrix"], row["dim"])
                    away = matrix.astype(np.int64) - centers[heaps.nearest]
                    made = (ids, tags, heaps.nearest.astype(np.int32), np.einsum("ij,ij->i", away, away))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["id", "known", "cluster", "distance"])

        folder = scratch(spark, "clustered")
        joined.mapInArrow(last, ASSIGNED).write.parquet(folder)
    finally:
        tables.close()
    own = F.when(F.col("known") == 1, F.col("id")).alias(vec_id)
    assigned = spark.read.schema(ASSIGNED).parquet(folder).select(own, "cluster", "distance")
    return assigned, centers.tolist(), scanned


def with_inertia(assigned: DataFrame, centers: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (distances summed over cluster and all) and ``centroid_sha256``."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers)]
    # One row for each cluster, of which there are as many as the caller asked for.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("bigint").alias("cluster_inertia"))
    whole = assigned.agg(F.sum(F.col("distance").cast("decimal(38,0)"))).first()[0]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    facts = sums.join(named, "cluster").withColumn("inertia", F.lit(None if whole is None else int(whole)).cast("bigint"))
    return assigned.join(F.broadcast(facts), "cluster")
