"""SimHash near-dedup with multi-index hashing.

Fingerprints are cut into segments. If two differ in at most D bits, then in
some segment i they differ in at most r_i bits, whenever the r_i + 1 add up to
more than D. So each fingerprint looks up the small Hamming ball around its own
segment value in that segment's table, and every match is checked over all 64
bits. Equal fingerprints are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import components, unused
from corpuslens.operators.storage import materialised

DISTANCE = 4
WIDTH = 4  # words in a shingle
SEED = 42
BITS = 64
STEP = 1 << 15  # shingles that are spread into bits at a time
CROWD = 2048  # members from which a table's entry is linked by midpoints and not pair by pair


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 majority bits of the shingles' XXH64 hashes; no words give zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    total, ones = max(1, len(words) - width + 1), np.zeros(BITS, np.int64)
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8", total)
    for at in range(0, total, STEP):
        part = np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and ``fp`` (signed long) for each row; nothing is shuffled."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            prints = [fingerprint(t.as_py(), width) for t in frame.column("text")]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, fp long")


def plan_segments(count: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """Segments (shift, bits, radius) that cost the fewest look-ups and chance matches.

    Every plan finds all pairs; the number of fingerprints only decides how long
    the segments are, so that chance matches stay few.
    """
    best = None
    for m in range(2, distance + 2):
        spare = distance + 1 - m  # what the radii add up to
        radii = [spare // m + (i < spare % m) for i in range(m)]
        bits = [BITS // m + (i < BITS % m) for i in range(m)]
        balls = [sum(comb(b, k) for k in range(r + 1)) for b, r in zip(bits, radii)]
        cost = sum(ball * (1 + count / 2**b) for ball, b in zip(balls, bits))
        if best is None or cost < best[0]:
            shifts = [sum(bits[:i]) for i in range(m)]
            best = (cost, list(zip(shifts, bits, radii)))
    return best[1]


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _ball(segment: int, value: Column, masks: list[int]) -> Column:
    """The places that a segment's value looks up: itself, and what it answers for around it."""
    ball = F.array(*[F.lit(m).cast("bigint") for m in masks])
    takes = F.filter(ball, lambda m: F.bit_count(value.bitwiseAND(m)) * 2 >= F.bit_count(m))
    return F.transform(takes, lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m).alias("value")))


def _around(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``mid``: every value within ``radius`` bits of each fingerprint."""
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(BITS, radius)])
    return materialised(prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid")))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a``, ``b`` of stored, distinct fingerprints ``fp``, enough for their components.

    Every pair within ``distance`` is either listed or joined by a path of listed
    pairs. Of two values that differ in a mask, one holds at least half of the
    mask's bits, and only it looks the other up. In an entry with more than
    ``CROWD`` members all pairs would be too many: such crowded fingerprints are
    linked by midpoints instead. Two that differ in at most ``distance`` bits have
    a common value within half of that of one (rounded down) and of the other
    (rounded up), and two such are within ``distance``; each points at the
    smallest member, by the lesser radius, of every value it shares.
    """
    count = prints.count()
    segments = plan_segments(count, distance)
    table_rows, probe_rows = [], []
    for i, (shift, bits, radius) in enumerate(segments):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        table_rows.append(F.struct(F.lit(i).alias("seg"), value.alias("value")))
        probe_rows.append(_ball(i, value, _masks(bits, radius)))
    table = prints.select(F.explode(F.array(*table_rows)).alias("at"), "fp").select("at.seg", "at.value", "fp")
    sizes = table.groupBy("seg", "value").agg(F.count("*").alias("members")).where(F.col("members") > CROWD)
    crowded_at = materialised(sizes.select("seg", "value", F.lit(True).alias("crowd")))
    crowds = not crowded_at.isEmpty()
    probes = prints.select(F.explode(F.concat(*probe_rows)).alias("at"), F.col("fp").alias("own")).select("at.seg", "at.value", "own")
    if crowds:
        crowd = materialised(table.join(crowded_at, ["seg", "value"]).select("fp").distinct())
        mark = crowd.select(F.col("fp").alias("own"), F.lit(True).alias("busy"))
        # Both crowded: the midpoints link them. One crowded: it is looked up by the other.
        table = table.join(crowd.withColumn("busy", F.lit(True)), "fp", "left").select("seg", "value", "fp", F.col("busy").isNotNull().alias("full"))
        probes = probes.join(mark, "own", "left").select("seg", "value", "own", F.col("busy").isNotNull().alias("self_full"))
        pairs = probes.where("not self_full").join(table, ["seg", "value"]).select("own", "fp").unionByName(
            probes.where("self_full").join(table.where("not full"), ["seg", "value"]).select("own", "fp")
        )
    else:
        pairs = probes.join(table, ["seg", "value"]).select("own", "fp")
    near = F.bit_count(F.col("own").bitwiseXOR(F.col("fp"))) <= distance
    found = pairs.where((F.col("own") != F.col("fp")) & near).select(
        F.greatest("own", "fp").alias("a"), F.least("own", "fp").alias("b")
    ).distinct()
    if not crowds:
        return found
    # Both balls are one where the distance is even; else members of the smaller name the entry.
    near_ball = _around(crowd, distance // 2)
    wide_ball = near_ball if distance % 2 == 0 else _around(crowd, distance - distance // 2)
    least = near_ball.groupBy("mid").agg(F.min("fp").alias("b"))
    stars = wide_ball.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return found.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row.

    Needs ``doc_id`` and ``text``; other columns are not read. ``component_id``
    is the smallest ``doc_id`` that can be reached over links. Null and empty
    texts have the fingerprint zero and are linked like others; a null
    ``doc_id`` counts as the largest, and is the component's only if there is no
    other. Repeated rows come back repeated. Only distinct fingerprints are
    compared. An empty table gives an empty result.
    """
    prints = materialised(fingerprints(docs, width))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialised(smallest)
    grouped = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    stored = materialised(rooted)
    names = stored.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(stored.join(names, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is their component's, with their own columns.

    Of repeated rows with that id one stays, the one with the shortest text; rows
    with a null ``doc_id`` all stay, as no id can name them. The texts are
    shuffled once, by ``doc_id``.
    """
    found = near_duplicates(docs, distance, width)
    side, number = unused(docs, "_keep", "_number")
    keep = found.where("component_id is not null").select(F.col("component_id").alias(side)).distinct()
    own = docs.columns
    order = Window.partitionBy("doc_id").orderBy(F.length("text"), F.xxhash64("text"))
    kept = docs.join(keep, F.col("doc_id") == F.col(side), "left_semi").withColumn(number, F.row_number().over(order))
    return kept.where(F.col(number) == 1).select(*own).unionByName(docs.where(F.col("doc_id").isNull()))
