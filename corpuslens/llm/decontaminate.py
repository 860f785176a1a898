"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

An alignment that reaches the least score holds a known number of the item's word
pairs within a known span (see ``bounds``). Of an item's pairs the commonest in the
corpus can therefore be left out: with the rarest ``pairs - need + 2`` as seeds, every
such alignment still holds two of them (or one, where it need hold no more). So no
leak is missed, and two rare pairs near each other are seldom chance.

The corpus is read once for the places of seeds, whatever the size of the item
table; a sieve of a fixed size, made of the items' n-grams, keeps nearly all other
words out of the shuffle. Places meet items by a join on the n-gram's hash, and only
the documents with such passages are read again, to align each passage to its item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.arrays import pinned
from corpuslens.llm.common import Steps, lowered, unused, word_list
from corpuslens.operators.storage import join_few, materialised

MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE = 0.6  # of the score that the whole item against itself has
SEEDS_TOGETHER = 2  # seeds that a passage must hold within an item's span, where the item allows it
SIEVE_BITS = 26  # 8 MB, whatever the items
PLACES = "doc long, pos int, size int, code long"


def item_words(items: DataFrame) -> DataFrame:
    """``item_id``, ``words`` of items with words; null and empty ones can't leak."""
    words = word_list(lowered(F.coalesce(F.col("text"), F.lit(""))))
    return pinned(items.select("item_id", "text"), words=words).where(F.size("words") > 0).select("item_id", "words")


def bounds(n: int, least: float) -> tuple[int, int, int]:
    """What an alignment of at least ``least`` to an item of ``n`` words holds: word pairs, words, and its span.

    With m matches and e words that miss or are skipped, 2m - e is at least the
    score S = 2n * least, and m is at most n. The matches are at most e + 1 runs,
    so that at least m - e - 1 >= S - n - 1 neighbouring pairs match. At least
    S / 2 words match, and the stretch has at most m + e <= 3n - S words.
    """
    score = max(1, math.ceil(MATCH * n * least - 1e-9))
    return score - n - 1, -(-score // 2), 3 * n - score


def _grams(words: list[bytes], sizes: set[int], known: dict[bytes, int]) -> dict[int, np.ndarray]:
    """A number for each word (size 1) and each pair of neighbours (size 2)."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    plain = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    made = {1: plain * np.uint64(0x9E3779B97F4A7C15)} if 1 in sizes else {}
    if 2 in sizes:
        made[2] = (plain[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (plain[1:] + (plain[1:] << np.uint64(17)))
    return {size: codes.view(np.int64) for size, codes in made.items()}


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ (codes >> 29)) & ((1 << SIEVE_BITS) - 1)).astype(np.int64)


def gram_places(texts: DataFrame, sizes: set[int], sieve: bytes | None = None) -> DataFrame:
    """``doc``, ``pos``, ``size``, ``code``: places of n-grams in ``doc``, ``text``; with a sieve only of those it holds."""
    sent = None if sieve is None else texts.sparkSession.sparkContext.broadcast(sieve)
    most_known = 1 << 18  # words whose hashes a task remembers at most

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else np.frombuffer(sent.value, np.uint8)
        known: dict[bytes, int] = {}
        for frame in frames:
            held: list[tuple] = []
            for doc, text in zip(frame.column("doc").to_pylist(), frame.column("text").cast(pa.binary()), strict=True):
                # Of bytes, only A-Z are lower-cased and only the six ASCII gaps part words.
                words = (text.as_py() or b"").lower().split()
                if len(known) > most_known:
                    known.clear()
                for size, codes in _grams(words, sizes, known).items():
                    pos = np.arange(len(codes), dtype=np.int32)
                    if bits is not None:
                        slot = _slot(codes)
                        pos = pos[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    if len(pos):
                        held.append((np.full(len(pos), doc), pos, np.full(len(pos), size, np.int32), codes[pos]))
            if held:
                made = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays(made, ["doc", "pos", "size", "code"])

    return texts.select("doc", "text").mapInArrow(batches, PLACES)


def _sieve(codes: DataFrame) -> bytes:
    """A bitmap of the items' n-grams, put together by Spark; its size is fixed."""

    def slots(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array(_slot(frame.column("code").to_numpy(zero_copy_only=False)))], ["slot"])

    placed = codes.select("code").mapInArrow(slots, "slot long")
    pages = placed.groupBy(F.shiftright("slot", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")
    )
    out = bytearray(1 << (SIEVE_BITS - 3))
    # At most 2048 pages of 4 kB.
    for row in pages.collect():
        out[row["page"] << 12 : (row["page"] << 12) + len(row["bits"])] = row["bits"]
    return bytes(out)


def _limits(least: float) -> list[Column]:
    """For items with ``words``: ``n``, the n-gram ``size``, how many an alignment holds (``need``), and its ``span``."""
    n = F.size("words")
    score = F.greatest(F.lit(1), F.ceil(F.lit(float(MATCH * least)) * n - 1e-9).cast("int"))
    pairs, single = score - n - 1, F.ceil(score / 2).cast("int")
    return [
        n.alias("n"),
        F.when(pairs >= 1, 2).otherwise(1).alias("size"),
        F.when(pairs >= 1, pairs).otherwise(single).alias("need"),
        (3 * n - score).alias("span"),
    ]


def seeds(items: DataFrame, places: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest n-grams of each item, as many as leave no alignment without ``together`` of them."""
    held = places.join(items.select(F.col("number").alias("doc"), "size", "n", "need", "span"), ["doc", "size"])
    counted = held.join(counts, ["size", "code"], "left")
    rarest = Window.partitionBy("doc").orderBy(F.coalesce("times", F.lit(0)), "code", "pos")
    together = F.least(F.lit(SEEDS_TOGETHER), F.col("need"))
    ranked = counted.withColumn("rank", F.row_number().over(rarest)).withColumn("together", together)
    grams = F.col("n") - F.col("size") + 1
    return (
        ranked.where(F.col("rank") <= grams - F.col("need") + F.col("together"))
        .select(F.col("doc").alias("number"), "size", "code", "span", "together").distinct()
    )


def passages(hits: DataFrame) -> DataFrame:
    """``doc``, ``number``, ``low``, ``high``: stretches of words that an alignment can lie in; those that touch are one.

    ``hits`` are places of seeds. A stretch begins at a seed whose next one is within
    the item's span. The rows of one document and item are what a window holds.
    """
    order = Window.partitionBy("doc", "number").orderBy("pos")
    last = F.when(F.col("together") == 1, F.col("pos")).otherwise(F.lead("pos", 1).over(order))
    cut = hits.withColumn("last", last).where(F.col("last") - F.col("pos") + F.col("size") <= F.col("span")).select(
        "doc", "number",
        F.greatest(F.lit(0), F.col("last") + F.col("size") - F.col("span")).alias("low"),
        (F.col("pos") + F.col("span")).alias("high"),
    )
    by_low = Window.partitionBy("doc", "number").orderBy("low", "high")
    before = by_low.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("low") > F.max("high").over(before)).cast("int"), F.lit(0))
    island = F.sum("apart").over(by_low.rowsBetween(Window.unboundedPreceding, 0))
    parted = cut.withColumn("apart", apart).withColumn("island", island)
    return parted.groupBy("doc", "number", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def _align(a: np.ndarray, item: np.ndarray) -> int:
    row, best = np.zeros(len(a) + 1, np.int64), 0
    steps = np.arange(len(a) + 1) * GAP
    for word in item:
        same = np.where(a == word, MATCH, MISS)
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(np.maximum(row[:-1] + same, row[1:] + GAP), 0)
        # A gap in the item costs the same at each step: the best start so far, less the way.
        row = np.maximum.accumulate(fresh - steps) + steps
        best = max(best, int(row.max(initial=0)))
    return best


def align(words: list[str], item: list[str]) -> int:
    """Smith-Waterman: the best score of a stretch of ``words`` against one of ``item``."""
    numbers: dict[str, int] = {}
    a = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return _align(a, np.array([numbers.get(w, -1) for w in item], np.int64))


def _scored(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``number``, ``score`` of rows with the passage's and the item's words."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            pairs = zip(frame.column("passage").to_pylist(), frame.column("words").to_pylist(), strict=True)
            scores = [align(passage, item) / (MATCH * len(item)) for passage, item in pairs]
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), frame.column("number"), pa.array(scores, pa.float64())], ["doc_id", "number", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "number", "passage", "words").mapInArrow(batches, f"doc_id {kind}, number long, score double")


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, min_words: int = 1) -> DataFrame:
    """Pairs ``doc_id``, ``item_id``, ``score``: the item is in the document, whole or edited.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``;
    other columns are not read. Words are lower-cased (A-Z). ``score`` is the
    best alignment's share of the item's own score; every pair that reaches
    ``least`` is found. Items of fewer than ``min_words`` words are left aside: one of
    a common word or two is in very many documents, and with the default of 1 it is
    reported for each. Null and empty texts leak nothing. Repeated rows give
    one pair, with the largest score. Empty tables give an empty result.
    """
    steps = Steps(docs.sparkSession, "decontaminate")
    listed = item_words(items).where(F.size("words") >= min_words)
    tests = steps.write("items", listed.withColumn("number", F.monotonically_increasing_id()).select("*", *_limits(least)))
    sizes = {row["size"] for row in tests.select("size").distinct().collect()}
    whole = tests.select(F.col("number").alias("doc"), F.array_join("words", " ").alias("text"))
    places = steps.write("item-places", gram_places(whole, sizes).join(tests.select(F.col("number").alias("doc"), "size"), ["doc", "size"]))
    # A document is known by the hash of its id and text; should two share one, they only get more passages to align.
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    hits = steps.write("hits", gram_places(keyed, sizes, _sieve(places)))
    chosen = steps.write("seeds", seeds(tests, places, hits.groupBy("size", "code").agg(F.count("*").alias("times"))))
    found = steps.write("passages", passages(hits.join(chosen, ["size", "code"])))
    steps.drop("hits", "seeds", "item-places")
    lists = steps.write("lists", found.groupBy("doc").agg(F.collect_list(F.struct("number", "low", "high")).alias("stretches")))
    words = pinned(join_few(keyed, lists, ["doc"]), words=word_list(lowered(F.coalesce("text", F.lit("")))))
    cut = words.select("doc_id", "words", F.explode("stretches").alias("at")).select(
        "doc_id", "at.number", F.slice("words", F.col("at.low") + 1, F.col("at.high") - F.col("at.low")).alias("passage")
    )
    scored = _scored(join_few(cut, tests.select("number", "words"), ["number"])).where(F.col("score") >= least)
    best = steps.write("scores", scored.groupBy("doc_id", "number").agg(F.max("score").alias("score")))
    names = tests.select("number", "item_id")
    rows = best.join(names, "number").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
    done = materialised(rows)
    steps.drop("items", "passages", "lists", "scores")
    return done


def keep_clean(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, min_words: int = 1) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with their own columns.

    Of rows that share an id, null included, none stays if one of them leaks. For
    nulls, short items and empty tables see :func:`leaks`.
    """
    (side,) = unused(docs, "_leaked")
    found = leaks(docs, items, least, min_words).select(F.col("doc_id").alias(side)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(side)), "left_anti")
