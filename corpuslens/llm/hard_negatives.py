"""Hard negatives by a secondary-sort shuffle.

Scored pairs are records under the key (anchor, descending score, id), spread by
anchor and sorted by the whole key inside each partition. A streaming pass over
the sorted records opens a window at each positive and hands out negatives to the
open windows; it holds one anchor's windows and no list of its records.

The anchors are a stated set of queries against all rows. They meet the rows in
blocks, twice: first a block of rows gives each anchor its best positives; then,
with an anchor's positives known, the block gives the first negatives of each of
its windows. What else a block holds can be no answer, so no more than a window's
size for each anchor, window and block is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import Steps
from corpuslens.llm.vectors import in_blocks, scaled, unpacked, usable

ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 1024
# Anchors scored at one go: a task holds their scores against one block.
AT_ONCE = 128
SLOTS_PER_CORE = 4
BLOCKS_PER_SLOT = 8
PAIRS = "ablock bigint, at int, anchor_id bigint, score bigint, id bigint"
FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every sum stays below 2**53."""
    most = lambda m: int(np.abs(m.astype(np.int64)).max(initial=0))
    kind = np.float64 if a.shape[1] * most(a) * most(b) < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _first(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the columns of its ``n`` first fitting scores, highest first, ties by id."""
    low = np.iinfo(np.int64).min
    held = np.where(fits, scores, low)
    if scores.shape[1] > n:
        fits = fits & (held >= np.partition(held, -n, axis=1)[:, -n][:, None])
    line, column = np.nonzero(fits)
    order = np.lexsort((ids[column], -scores[line, column], line))
    line, column = line[order], column[order]
    begins = np.searchsorted(line, line)
    keep = np.arange(len(line)) - begins < n
    return line[keep], column[keep]


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers between ``low`` and ``high`` per cent of a score."""
    return -(-low * score // 100), high * score // 100


def _pairs(batches: Iterator[pa.RecordBatch], choose) -> Iterator[pa.RecordBatch]:
    """Scores each pair of blocks; ``choose`` picks lines and columns for a stretch of anchors."""
    for batch in batches:
        for k in range(batch.num_rows):  # a pair is large: one at a time leaves Arrow's memory
            row = batch.slice(k, 1).to_pylist()[0]
            ids, tags, matrix = unpacked(row["ids"], row["tags"], row["matrix"], row["dim"])
            a_ids, a_tags, a_matrix = unpacked(row["a_ids"], row["a_tags"], row["a_matrix"], row["dim"])
            for start in range(0, len(a_ids), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                scores = _scores(a_matrix[part], matrix)
                same = a_tags[part][:, None] == tags[None, :]
                if row["positives"] is None:
                    # A row is no partner of itself; rows are all different, so it is the one that is equal in all.
                    line, column = np.nonzero(same & (a_ids[part][:, None] == ids[None, :]))
                    itself = (a_matrix[part][line] == matrix[column]).all(axis=1)
                    same[line[itself], column[itself]] = False
                line, column = choose(row, start, scores, same, ids)
                made = (np.full(len(line), row["ablock"]), (line + start).astype(np.int32), a_ids[line + start], scores[line, column], ids[column])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["ablock", "at", "anchor_id", "score", "id"])


def _slots(blocks: int, cores: int) -> int:
    """How many slots the blocks of rows lie in: some for each core, and few blocks in each."""
    return max(1, min(blocks, max(SLOTS_PER_CORE * cores, -(-blocks // BLOCKS_PER_SLOT))))


def _paired(rows: DataFrame, anchors: DataFrame, slots: int) -> DataFrame:
    """Every block of anchors beside every block of rows of the same size, by a join on slots.

    Blocks of rows lie in slots and stay single; the far smaller blocks of anchors
    are copied to all slots. The copies grow with both sides, whatever size is
    guessed for them, so they are shuffled and never sent through the driver. They
    stream past the few blocks of their slot, which the join holds.
    """
    everywhere = anchors.select(
        "dim", F.col("block").alias("ablock"), F.col("ids").alias("a_ids"), F.col("tags").alias("a_tags"),
        F.col("matrix").alias("a_matrix"), "positives", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    placed = rows.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    return everywhere.hint("merge").join(placed, ["dim", "slot"]).drop("slot", "block")


def _stream(sorted_rows: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    current, windows = None, []
    for batch in sorted_rows:
        out: list[tuple] = []
        for ablock, at, anchor, score, kind, ident in zip(*(batch.column(c).to_pylist() for c in ("ablock", "at", "anchor_id", "score", "kind", "id"))):
            if (ablock, at) != current:
                current, windows = (ablock, at), []
            if kind == 0:
                windows.append([ident, score, *_bounds(score, low, high), 0])
                continue
            # Scores only fall: a window that is full or passed is over.
            windows = [w for w in windows if w[4] < negatives and w[2] <= score]
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    out.append((anchor, w[0], w[4], ident, w[1], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    factor: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """For each anchor and positive its first negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and scores.

    Components are ``floor(factor * x)`` and a score is their inner product.
    Positives are the anchor's ``positives`` best other rows of its label,
    negatives the ``negatives`` best rows of another label whose score is between
    ``low`` and ``high`` (100 at most) per cent of the positive's; ties go by
    smaller id. ``is_anchor`` is a condition on the columns of ``vectors``; null is
    no. Ids and labels are whole numbers. Rows with a null id, label or vector, an
    empty one, or one that :func:`corpuslens.llm.vectors.usable` turns down take no
    part. Vectors of another size than the anchor's are not compared with it. Rows
    equal in id, label and vector count once; rows that share an id otherwise are
    rows of their own. An empty table, or one without anchors, gives no rows.
    Other columns are left aside.
    """
    if high > 100 or not 0 < low <= high:
        raise ValueError("A window lies between low and high per cent, 100 at most")
    spark = vectors.sparkSession
    steps = Steps(spark, "hard-negatives")
    whole = usable(F.col(vector), factor) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()
    rows = vectors.where(whole).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("tag"),
        scaled(F.col(vector), factor).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = steps.write("rows", rows.groupBy("id", "tag", "v").agg(F.max("asks").alias("asks")))
    blocks = steps.write("blocks", in_blocks(rows, ROWS_PER_BLOCK))
    anchors = steps.write("anchors", in_blocks(rows.where("asks"), ANCHORS_PER_BLOCK))
    steps.drop("rows")
    slots = _slots(blocks.select("block").count(), spark.sparkContext.defaultParallelism)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, lambda row, start, scores, same, ids: _first(scores, same, ids, positives))

    def choose(row: dict, start: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> tuple:
        size = len(scores)
        lows, highs = np.ones((positives, size), np.int64), np.zeros((positives, size), np.int64)
        for p in row["positives"]:
            if start <= p["at"] < start + size:
                lows[p["rank"] - 1, p["at"] - start], highs[p["rank"] - 1, p["at"] - start] = _bounds(p["score"], low, high)
        picked = [np.zeros(0, np.int64)]
        for least, most in zip(lows, highs, strict=True):
            fits = ~same & (scores >= least[:, None]) & (scores <= most[:, None])
            line, column = _first(scores, fits, ids, negatives)
            picked.append(line * scores.shape[1] + column)
        return np.divmod(np.unique(np.concatenate(picked)), scores.shape[1])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, choose)

    unasked = anchors.withColumn("positives", F.lit(None).cast("array<struct<at:int,rank:int,score:bigint>>"))
    order = Window.partitionBy("ablock", "at").orderBy(F.desc("score"), "id")
    opened = steps.write(
        "positives",
        _paired(blocks, unasked, slots).mapInArrow(best, PAIRS)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives),
    )
    known = opened.groupBy(F.col("ablock").alias("block")).agg(F.collect_list(F.struct("at", "rank", "score")).alias("positives"))
    met = _paired(blocks, anchors.join(known, "block"), slots).mapInArrow(near, PAIRS)
    records = opened.drop("rank").withColumn("kind", F.lit(0)).unionByName(met.withColumn("kind", F.lit(1)))
    # At one score the positive comes first, so that its window is open for negatives that tie with it.
    in_order = records.repartition("ablock", "at").sortWithinPartitions("ablock", "at", F.desc("score"), "kind", "id")
    return in_order.mapInArrow(lambda batches: _stream(batches, negatives, low, high), FOUND)
