"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are spread over shards of a few thousand. A shard's packing is bred on
several islands: a crossover injects whole well-filled sequences of another
parent, takes out the sequences that now hold a piece twice, and puts displaced
pieces where they fit best. After each round the islands of a shard hand their
best packing on to the next island. Every shard is first packed once by best fit,
and one that reaches its lower bound that way breeds nothing.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import default_paths, encoder
from corpuslens.operators.storage import materialised

ROOM = 2048
SHARD = 4096  # pieces that are packed with each other: a shard wastes less than one sequence
ISLANDS = 3
ROUNDS = 2
POPULATION = 6
GENERATIONS = 8

Bins = list[list[int]]


def pieces(docs: DataFrame, room: int = ROOM, paths: tuple[str, str] | None = None, end: int = 0) -> DataFrame:
    """Token pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its ids and then ``end``. A longer one than ``room`` is cut
    into full pieces behind a first one that takes the rest.
    """
    json_path, rank_path = paths or default_paths()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(json_path, rank_path)
        for frame in frames:
            rows = []
            for at, text in enumerate(frame.column("text")):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % room or room, len(ids), room), len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((at, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            at, *rest = zip(*rows) if rows else [()] * 5
            ids = frame.column("doc_id").take(pa.array(at, pa.int64()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, k) for c, k in zip(rest, kinds)]], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


# --- one shard ----------------------------------------------------------------


def best_fit(lengths: list[int], order: list[int], room: int, into: Bins | None = None) -> Bins:
    """Puts pieces, in the order given, where the least room is left over."""
    bins = into if into is not None else []
    left = [room - sum(lengths[i] for i in b) for b in bins]
    open_ = sorted((free, k) for k, free in enumerate(left) if free)
    for i in order:
        at = bisect_left(open_, (lengths[i], -1))
        if at < len(open_):
            free, k = open_.pop(at)
            bins[k].append(i)
        else:
            free, k = room, len(bins)
            bins.append([i])
        if free > lengths[i]:
            insort(open_, (free - lengths[i], k))
    return bins


def fitness(lengths: list[int], bins: Bins, room: int) -> tuple[int, float]:
    """Fewer sequences are better, then fuller ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / room) ** 2 for b in bins)


def crossover(lengths: list[int], one: Bins, other: Bins, room: int, rng: random.Random) -> Bins:
    """Injects some of the fullest sequences of ``one`` into ``other``."""
    full = sorted(one, key=lambda b: -sum(lengths[i] for i in b))
    full = full[: max(1, len(full) // 2)]
    injected = [b[:] for b in full if rng.random() < 0.5] or [full[0][:]]
    taken = {i for b in injected for i in b}
    kept = [b[:] for b in other if taken.isdisjoint(b)]
    placed = taken.union(*kept)
    displaced = sorted((i for i in range(len(lengths)) if i not in placed), key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, room, injected + kept)


def mutated(lengths: list[int], bins: Bins, room: int, rng: random.Random) -> Bins:
    """Empties a few of the least filled sequences and some others, and fits their pieces anew."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    drop = set(order[: max(1, len(bins) // 50)]) | {k for k in range(len(bins)) if rng.random() < 0.05}
    loose = sorted((i for k in drop for i in bins[k]), key=lambda i: -lengths[i])
    return best_fit(lengths, loose, room, [b[:] for k, b in enumerate(bins) if k not in drop])


def evolve(lengths: list[int], elites: list[Bins], room: int, rng: random.Random) -> Bins:
    """The best packing an island finds, starting from the elites that it holds."""
    bound = -(-sum(lengths) // room)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = elites[:] or [best_fit(lengths, order, room)]
    while len(people) < POPULATION:
        shaken = sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        if min(map(len, people)) <= bound:
            break
        people.append(best_fit(lengths, shaken, room))
    score = lambda b: fitness(lengths, b, room)
    people.sort(key=score, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0]) <= bound:
            break
        young = []
        for _ in range(POPULATION // 2):
            one, other = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            young.append(mutated(lengths, crossover(lengths, one, other, room, rng), room, rng))
        people = sorted(people + young, key=score, reverse=True)[:POPULATION]
    return people[0]


def _numbers(bins: Bins, count: int) -> list[int]:
    place = [0] * count
    for k, b in enumerate(bins):
        for i in b:
            place[i] = k
    return place


def _bins(place: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(place, default=-1) + 1)]
    for i, k in enumerate(place):
        bins[k].append(i)
    return bins


def _pack_once(room: int):
    """Best fit in order of length, and the bound that no packing can go below."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        lengths = items.sort_values("row")["length"].tolist()
        bins = best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), room)
        used, full = fitness(lengths, bins, room)
        made = {"shard": [items["shard"].iloc[0]], "place": [_numbers(bins, len(lengths))], "used": [-used], "full": [full]}
        return pd.DataFrame(made | {"bound": [-(-sum(lengths) // room)]})

    return run


def _evolve_round(number: int, room: int):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        items = items.sort_values("row")
        lengths = items["length"].tolist()
        if not lengths:
            return pd.DataFrame({"shard": [], "island": [], "place": [], "used": [], "full": []})
        rng = random.Random(f"{number}/{shard}/{island}")
        best = evolve(lengths, [_bins(list(p)) for p in elites.sort_values("from")["place"]], room, rng)
        used, full = fitness(lengths, best, room)
        return pd.DataFrame(
            {"shard": [shard], "island": [island], "place": [_numbers(best, len(lengths))], "used": [-used], "full": [full]}
        )

    return run


def _bred(items: DataFrame, start: DataFrame, room: int) -> DataFrame:
    """``shard``, ``place``: the best packing that the islands of each shard find from a first one."""
    each = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    narrow = items.select("shard", "row", "length", each)
    state = "shard int, island int, place array<int>, used long, full double"
    elites = start.select("shard", each, "place", "used", "full")
    for number in range(ROUNDS):
        # An island goes on from its own best and from that of the one before it.
        own = elites.select("shard", "island", F.col("island").alias("from"), "place")
        sent = elites.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("island").alias("from"), "place")
        elites = materialised(
            narrow.groupBy("shard", "island")
            .cogroup(own.unionByName(sent).groupBy("shard", "island"))
            .applyInPandas(_evolve_round(number, room), state)
        )
    return elites.groupBy("shard").agg(F.min_by("place", F.struct("used", -F.col("full"), "island")).alias("place"))


def _placed(room: int):
    def run(key: tuple, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("row").reset_index(drop=True)
        items["bin"] = best["place"].iloc[0]
        items["sequence_id"] = items.groupby("bin")["row"].transform("min")
        items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
        return items[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, room: int = ROOM, paths: tuple[str, str] | None = None, shard: int = SHARD) -> DataFrame:
    """Packs whole documents into sequences of at most ``room`` tokens.

    Needs ``doc_id`` and ``text``; other columns are not read. Returns a row for
    each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. A null or empty text is the end token alone.
    Full pieces are sequences of their own. Repeated rows are packed each. An
    empty table gives an empty result. Only lengths and numbers are shuffled,
    and a shard holds about ``shard`` pieces whatever the table's size.
    """
    found = materialised(pieces(docs, room, paths).withColumn("row", F.monotonically_increasing_id()))
    loose = found.where(F.col("length") < room)
    shards = max(1, -(-loose.count() // shard))
    # Numbers of a task follow each other, so hashing them deals evenly whatever the keys are.
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    first = materialised(
        dealt.select("shard", "row", "length").groupBy("shard")
        .applyInPandas(_pack_once(room), "shard int, place array<int>, used long, full double, bound long")
    )
    # A shard at its bound is done; only the others go to the islands.
    above = first.where("used > bound").drop("bound")
    best = first.select("shard", "place")
    if not above.isEmpty():
        bred = _bred(dealt.join(above.select("shard"), "shard"), above, room)
        best = first.where("used <= bound").select("shard", "place").unionByName(bred)
    kind = found.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_placed(room), columns)
    alone = found.where(F.col("length") >= room).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return placed.unionByName(alone)
