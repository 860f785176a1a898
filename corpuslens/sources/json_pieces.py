"""A large JSON document as small ones: of its list no more than a piece is held, however it is laid out.

A document ``{root, first, files}`` is read twice as a stream: once to see that it is
whole and what stands beside its list, then for the pieces. Documents that are not
plain (broken ones, lists of documents, other encodings, names that come twice,
entries of other types) are told apart and left to Spark's own reader.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.operators.storage import materialised
from corpuslens.sources.files import TASKS_PER_CORE, open_store

CHUNK = 1 << 20  # bytes that are read at once
LARGEST = 1 << 26  # characters of one entry; a document with a larger one is not plain
# What Spark's reader turns down, at a thousand, is left to it.
DEEPEST, LONGEST_NUMBER = 900, 900
FILES_PER_PIECE = 500
CHARS_PER_PIECE = 1 << 20
KINDS = "path string, head string"
PIECES = "base bigint, document string"

_GAP = re.compile(r"[ \t\n\r]*")


class NotPlain(ValueError):
    pass


def _refused(constant: str) -> None:
    raise NotPlain(constant)


def _number(digits: str) -> float:
    if len(digits) > LONGEST_NUMBER:
        raise NotPlain(digits)
    return float(digits)


def _whole_number(digits: str) -> int:
    if len(digits) > LONGEST_NUMBER:
        raise NotPlain(digits)
    return int(digits)


_value_at = json.JSONDecoder(parse_float=_number, parse_int=_whole_number, parse_constant=_refused).raw_decode


def _is_shallow(value: object) -> bool:
    level = [value]
    for _ in range(DEEPEST):
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return True
    return False


def _texts(value: object) -> bool:
    return value is None or isinstance(value, list) and all(x is None or isinstance(x, str) for x in value)


def _text(value: object) -> bool:
    return value is None or isinstance(value, str)


def _is_place(value: object) -> bool:
    return value is None or type(value) is int and abs(value) < 1 << 62


def _is_file(value: object) -> bool:
    """Whether an entry is of the wanted types; only then it is read alike, whatever stands around it."""
    if value is None:
        return True
    if not isinstance(value, dict) or not (_text(value.get("path")) and _texts(value.get("headers")) and _text(value.get("parse_error"))):
        return False
    classes = value.get("classes")
    return classes is None or isinstance(classes, list) and all(
        c is None or isinstance(c, dict) and _text(c.get("name")) and _texts(c.get("public_methods")) for c in classes
    )


class _Text:
    """What is still to be read of a stream, a chunk at a time."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.decoder = stream, codecs.getincrementaldecoder("utf-8")()
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> None:
        left = len(self.text) - self.at
        if self.ended or left > LARGEST:
            raise NotPlain
        # As much again as is held, so that a long value is not begun anew too often.
        data = self.stream.read(max(CHUNK, left))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decoder.decode(data, self.ended), 0

    def mark(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = _GAP.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if self.ended:
                return ""
            self._more()

    def take(self, *wanted: str) -> str:
        found = self.mark()
        if found not in wanted:
            raise NotPlain
        self.at += 1
        return found

    def value(self, fits: Callable[[object], bool] = lambda value: True) -> str:
        """The text of the next value."""
        self.mark()
        while True:
            try:
                value, end = _value_at(self.text, self.at)
            except NotPlain:
                raise
            except ValueError:
                end = None  # not whole yet, or not at all
            if end is not None and (end < len(self.text) or self.ended):
                if not fits(value) or end - self.at > DEEPEST and not _is_shallow(value):
                    raise NotPlain
                start, self.at = self.at, end
                return self.text[start:end]
            self._more()


def _members(stream: BinaryIO) -> Iterator[tuple[str, str]]:
    """``root`` and ``first`` as they stand, and each entry of ``files``."""
    text, seen = _Text(stream), set()
    text.take("{")
    closed = text.mark() == "}"
    if closed:
        text.take("}")
    while not closed:
        if text.mark() != '"':
            raise NotPlain
        name = json.loads(text.value())
        text.take(":")
        if name in seen:
            raise NotPlain
        if name not in ("root", "first", "files"):
            text.value()
        elif name != "files":
            seen.add(name)
            yield name, text.value(_text if name == "root" else _is_place)
        else:
            seen.add(name)
            if text.mark() == "[":
                text.take("[")
                ended = text.mark() == "]"
                if ended:
                    text.take("]")
                while not ended:
                    yield name, text.value(_is_file)
                    ended = text.take(",", "]") == "]"
            elif text.value() != "null":
                raise NotPlain
        closed = text.take(",", "}") == "}"
    if text.mark():
        raise NotPlain


def head_of(stream: BinaryIO) -> str:
    """What stands beside the list, as the start of an object; an error if the document is not plain."""
    beside = {name: raw for name, raw in _members(stream) if name != "files"}
    return "{" + "".join(f'"{name}":{raw},' for name, raw in beside.items())


def pieces_of(stream: BinaryIO, head: str) -> Iterator[tuple[int, str]]:
    """Documents with a piece of the list each, and the place of its first entry."""
    base, held, chars = 0, [], 0
    for name, raw in _members(stream):
        if name != "files":
            continue
        held.append(raw)
        chars += len(raw)
        if len(held) == FILES_PER_PIECE or chars >= CHARS_PER_PIECE:
            yield base, f'{head}"files":[{",".join(held)}]}}'
            base, held, chars = base + len(held), [], 0
    if held:
        yield base, f'{head}"files":[{",".join(held)}]}}'


def _opened(path: str):
    store, plain = open_store(path)
    return store.open_input_stream(plain)


def in_pieces(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Files ``path`` as rows ``base, document``, and the paths of those that are not plain."""

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, heads = batch.column("path").to_pylist(), []
            for path in paths:
                try:
                    with _opened(path) as stream:
                        heads.append(head_of(stream))
                except (ValueError, OSError, RecursionError):  # Arrow's errors are of these kinds, too
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(heads, pa.string())], ["path", "head"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, head in zip(*(batch.column(c).to_pylist() for c in ("path", "head")), strict=True):
                with _opened(path) as stream:
                    for base, document in pieces_of(stream, head):
                        yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([document], pa.string())], ["base", "document"])

    spark = files.sparkSession
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = materialised(files.select("path").repartition(tasks).mapInArrow(kinds, KINDS))
    # As many as are broken; Spark's listing of a folder holds all of its paths in the same place.
    others = [r["path"] for r in known.where("head is null").collect()]
    return known.where("head is not null").repartition(tasks).mapInArrow(split, PIECES), others
