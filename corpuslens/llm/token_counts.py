"""Token counts that follow edits.

A document's pre-tokens, each with its characters and tokens, are held in
leaves of a few dozen; over the leaves stands a segment tree of sums. An edit
finds its place by the sums of characters, splits and encodes anew only the
pre-tokens it touches and their boundary context, and updates the sums above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import default_paths, encoder

LEAF = 32  # pre-tokens in a fresh leaf; one that grows to four times that has the tree built anew
KNOWN = 1 << 18  # pre-tokens whose number of tokens a worker remembers
LONG = 64  # longer pre-tokens are not remembered
# A pre-token's end depends on two characters behind it at most.
CONTEXT = 2

STATE = "leaf_sizes array<int>, piece_chars array<int>, piece_tokens array<int>, tree_chars array<int>, tree_tokens array<int>"
STATE_NAMES = ["leaf_sizes", "piece_chars", "piece_tokens", "tree_chars", "tree_tokens"]


class Known(dict):
    """Numbers of tokens of pre-tokens; begun anew when full. Very long ones are not kept."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        number = len(self.encode(piece))
        if len(piece) <= LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = number
        return number


class Counter:
    """Splits texts into pre-tokens by the vocabulary's pattern and counts their tokens."""

    def __init__(self, json_path: str, rank_path: str) -> None:
        import regex

        own = encoder(json_path, rank_path)
        pattern = regex.compile(own.pattern)
        self.split, self.pieces = pattern.finditer, pattern.findall
        self.tokens = Known(own.quick.encode_ordinary).__getitem__

    def tree(self, text: str) -> TokenTree:
        pieces = self.pieces(text)
        n = len(pieces)
        return TokenTree.of(np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(self.tokens, pieces), np.int32, n))


@lru_cache(maxsize=2)
def counter(json_path: str, rank_path: str) -> Counter:
    return Counter(json_path, rank_path)


def _heap(values: np.ndarray, leaves: int) -> np.ndarray:
    """Sums of fresh leaves and of the nodes above them."""
    base = 1 << (leaves - 1).bit_length()
    heap = np.zeros(2 * base, np.int32)
    if len(values):
        heap[base : base + leaves] = np.add.reduceat(values, np.arange(0, len(values), LEAF))
    while base > 1:
        heap[base // 2 : base] = heap[base : 2 * base : 2] + heap[base + 1 : 2 * base : 2]
        base //= 2
    return heap


@dataclass
class TokenTree:
    """Characters and tokens of all pre-tokens in a row, cut into leaves of ``sizes``.

    ``chars`` and ``tokens`` are heaps of sums: node k has the children 2k and
    2k+1, leaves start at ``base``. All arrays hold 32-bit integers.
    """

    sizes: np.ndarray
    piece_chars: np.ndarray
    piece_tokens: np.ndarray
    chars: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray) -> TokenTree:
        leaves = max(1, -(-len(chars) // LEAF))
        sizes = np.full(leaves, LEAF, np.int32)
        sizes[-1] = len(chars) - LEAF * (leaves - 1)
        return cls(sizes, chars, tokens, _heap(chars, leaves), _heap(tokens, leaves))

    @property
    def base(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def boundary(self, at: int) -> tuple[int, int, int]:
        """The last boundary that is not behind ``at``: leaf, pieces before it in the leaf, place."""
        k, before = 1, 0
        while k < self.base:
            k *= 2
            if before + int(self.chars[k]) <= at and self.chars[k + 1] > 0:
                before += int(self.chars[k])
                k += 1
        leaf = k - self.base
        start = int(self.sizes[:leaf].sum())
        places = before + np.cumsum(self.piece_chars[start : start + int(self.sizes[leaf])], dtype=np.int64)
        inside = int(np.searchsorted(places, at, "right"))
        return leaf, inside, int(places[inside - 1]) if inside else before

    def edit(self, text: str, at: int, cut: int, put: str, count: Counter) -> tuple[str, TokenTree, int]:
        """The text, its tree and the number of pre-tokens encoded anew after one edit."""
        at = min(max(at, 0), len(text))
        cut = min(max(cut, 0), len(text) - at)
        text = text[:at] + put + text[at + cut :]
        shift, settled = len(put) - cut, at + cut
        leaf, inside, place = self.boundary(max(0, at - CONTEXT))
        ends = np.cumsum(self.sizes)
        start = int(ends[leaf] - self.sizes[leaf])
        # Walks the old pieces beside the new ones until both have a boundary at the same place of the rest.
        first = old = start + inside
        old_place, fresh = place, []
        met = shift == 0 and place >= settled
        pieces = count.split(text, place)
        while not met:
            match = next(pieces, None)
            if match is None:
                old = len(self.piece_chars)
                break
            fresh.append(match.group())
            reached = match.end() - shift
            while old_place < max(settled, reached) and old < len(self.piece_chars):
                old_place += int(self.piece_chars[old])
                old += 1
            met = old_place == reached and reached >= settled
        old_leaf = max(leaf, int(np.searchsorted(ends, old)))
        sizes = self.sizes.copy()
        sizes[leaf] = inside + len(fresh) + int(ends[old_leaf]) - old
        sizes[leaf + 1 : old_leaf + 1] = 0
        rows = []
        for values, new in ((self.piece_chars, map(len, fresh)), (self.piece_tokens, map(count.tokens, fresh))):
            rows.append(np.concatenate([values[:first], np.fromiter(new, np.int32, len(fresh)), values[old:]]))
        if sizes[leaf] > 4 * LEAF:
            return text, TokenTree.of(*rows), len(fresh)
        heaps = [self.chars.copy(), self.tokens.copy()]
        for values, heap in zip(rows, heaps, strict=True):
            low, high = self.base + leaf, self.base + old_leaf
            heap[low] = values[start : start + int(sizes[leaf])].sum()
            heap[low + 1 : high + 1] = 0
            while low > 1:
                low, high = low // 2, high // 2
                heap[low : high + 1] = heap[2 * low : 2 * high + 2 : 2] + heap[2 * low + 1 : 2 * high + 2 : 2]
        return text, TokenTree(sizes, *rows, *heaps), len(fresh)

    def stored(self) -> tuple[np.ndarray, ...]:
        return self.sizes, self.piece_chars, self.piece_tokens, self.chars, self.tokens


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *arrays]))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _kinds(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def count_tokens(docs: DataFrame, carry: list[str] | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """Trees of whole texts: ``doc_id``, ``text``, columns to ``carry``, the state, ``n_tokens``.

    A null text is empty and has no tokens. The string of a special token is
    ordinary text. Repeated rows are counted each; nothing is shuffled. An empty
    table gives an empty result.
    """
    where, kept = paths or default_paths(), ["doc_id", "text", *(carry or [])]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(*where)
        for frame in frames:
            states, totals = [[] for _ in STATE_NAMES], []
            for text in frame.column("text"):
                tree = own.tree(text.as_py() or "")
                for column, value in zip(states, tree.stored()):
                    column.append(value)
                totals.append(tree.total)
            yield pa.RecordBatch.from_arrays(
                [*[frame.column(c) for c in kept], *[_lists(c) for c in states], pa.array(totals, pa.int64())],
                names=[*kept, *STATE_NAMES, "n_tokens"],
            )

    return docs.select(*kept).mapInArrow(batches, f"{_kinds(docs, kept)}, {STATE}, n_tokens long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins edits (``doc_id``, ``number``, ``at``, ``cut``, ``put``) to the state, in order of ``number``."""
    lists = edits.groupBy(F.col("doc_id").alias("_of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "at", "cut", "put"))), lambda e: F.struct(e["at"].cast("int").alias("at"), e["cut"].cast("int").alias("cut"), e["put"].alias("put"))).alias("edits")
    )
    return state.join(lists, F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def one_edit(at: Column, cut: Column, put: Column) -> Column:
    """An ``edits`` column of one edit that a row's own columns give."""
    return F.array(F.struct(at.cast("int").alias("at"), cut.cast("int").alias("cut"), put.alias("put")))


def apply_edits(state: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The state after each row's ``edits`` (``at``, ``cut``, ``put``, one after the other), by its tree.

    ``at`` and ``cut`` are code points of the text as it is by then, and are cut
    to it; null numbers are 0, a null ``put`` is empty, null ``edits`` are none.
    Adds ``n_encoded``, the pre-tokens that were encoded anew; ``n_tokens`` and
    ``text`` are those after the edits.
    """
    where = paths or default_paths()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(*where)
        for frame in frames:
            texts, states, totals, encoded = [], [[] for _ in STATE_NAMES], [], []
            for text, edits, *held in zip(
                frame.column("text"), frame.column("edits"), *[_arrays(frame.column(c)) for c in STATE_NAMES]
            ):
                tree, text, fresh = TokenTree(*held), text.as_py() or "", 0
                for e in edits.as_py() or []:
                    text, tree, n = tree.edit(text, e["at"] or 0, e["cut"] or 0, e["put"] or "", own)
                    fresh += n
                texts.append(text)
                for column, value in zip(states, tree.stored()):
                    column.append(value)
                totals.append(tree.total)
                encoded.append(fresh)
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(texts, pa.string()), *[_lists(c) for c in states], pa.array(totals, pa.int64()), pa.array(encoded, pa.int64())],
                names=["doc_id", "text", *STATE_NAMES, "n_tokens", "n_encoded"],
            )

    return state.select("doc_id", "text", "edits", *STATE_NAMES).mapInArrow(
        batches, f"{_kinds(state, ['doc_id'])}, text string, {STATE}, n_tokens long, n_encoded long"
    )
