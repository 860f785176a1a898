"""Source trees as a data source, for batches and streams.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").load("/data/projects/engine")
    spark.readStream.format("source_tree").load("/data/projects/engine")

A tree is cut into pieces of folder listings. A folder with many entries is several
pieces, each of which takes the entries whose names hash to it, so no task has to read
a large folder alone; only these entries are looked at. Where there are more than a few
hundred pieces, a task takes several of them. Links to folders are not entered; see
:func:`corpuslens.sources.files.list_tree` for the rest, and for warnings, which are
rows with a null content here.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corpuslens.functions.paths import SKIPPED_DIRECTORIES, SOURCE_EXTENSIONS
from corpuslens.sources.files import Entry, _described, _folders_and_count, _listed, open_store

SCHEMA = "path string, relative_path string, content binary, mtime timestamp, length bigint, warning string"
PER_PIECE = 1000  # entries of a folder that one piece reads, or more where that makes over MOST_SLOTS pieces
MOST_SLOTS = 64  # pieces of one folder, each of which goes through all its names
MOST_TASKS = 256  # up to so many pieces have tasks of their own
SETTLE_SECONDS = 1.0  # a file younger than this may still be written; a stream leaves it for its next batch


def is_source_name(path: str) -> bool:
    """The Python form of :func:`corpuslens.functions.paths.is_source_file`."""
    stem, dot, extension = path.rsplit("/", 1)[-1].rpartition(".")
    return bool(dot) and dot + extension in SOURCE_EXTENSIONS and bool(stem)


@dataclass
class Piece(InputPartition):
    """Files of one folder: those whose names hash to ``slot`` of ``slots``. A root that is a file is a piece of its own."""

    folder: str
    slot: int = 0
    slots: int = 1
    since: int = -1  # of the times of change, in nanoseconds: after this
    upto: int = 1 << 62
    alone: bool = False


@dataclass
class Pack(InputPartition):
    """Pieces that one task reads one after the other."""

    pieces: list[Piece]


def packed(pieces: list[Piece], counts: list[int]) -> list[InputPartition]:
    """Pieces as tasks of about equal numbers of entries; a listing counts as an entry."""
    if len(pieces) <= MOST_TASKS:
        return list(pieces)
    room = max(PER_PIECE, -(-(sum(counts) + len(counts)) // MOST_TASKS))
    packs, held = [Pack([])], 0
    for piece, count in zip(pieces, counts, strict=True):
        if packs[-1].pieces and held + count + 1 > room:
            packs.append(Pack([]))
            held = 0
        packs[-1].pieces.append(piece)
        held += count + 1
    return packs


class _Tree:
    def __init__(self, root: str):
        self.root = root
        self.store, self.top = open_store(root)

    def pieces(self, since: int = -1, upto: int = 1 << 62) -> list[InputPartition]:
        """Every folder's listing in pieces: names are counted here, files are looked at and read by the tasks."""
        about = self.store.get_file_info(self.top)
        if about.type == fs.FileType.File:
            return [Piece(self.top, since=since, upto=upto, alone=True)]
        if about.type != fs.FileType.Directory:
            raise FileNotFoundError(f"Unable to traverse {self.root}: no such folder")
        made, counts, todo = [], [], [self.top.rstrip("/") or "/"]
        while todo:
            folder = todo.pop()
            below, count = _folders_and_count(self.store, folder)
            todo += [path for path in below if path.rsplit("/", 1)[-1] not in SKIPPED_DIRECTORIES]
            slots = min(-(-count // PER_PIECE), MOST_SLOTS)
            made += [Piece(folder, slot, slots, since, upto) for slot in range(slots)]
            counts += [count // slots] * slots if slots else []
        return packed(made, counts)

    def all_rows(self, task: InputPartition) -> Iterator[tuple]:
        for piece in task.pieces if isinstance(task, Pack) else [task]:
            yield from self.rows(piece)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        def own(path: str) -> bool:
            return zlib.crc32(path.encode("utf-8", "surrogateescape")) % piece.slots == piece.slot

        found: Iterator[Entry] = (
            iter([_described(self.store.get_file_info(piece.folder))]) if piece.alone else _listed(self.store, piece.folder, own)
        )
        skip = len(self.top.rstrip("/")) + 1
        for path, kind, mtime, length, warning in found:
            # The warning about a folder itself is the row of one of its pieces.
            if not own(path):
                continue
            name = path.rsplit("/", 1)[-1] if piece.alone else path[skip:]
            if warning and piece.since < 0:
                yield path, name, None, None, 0, warning
            elif kind == "file" and is_source_name(path) and piece.since < mtime <= piece.upto:
                changed = datetime.fromtimestamp(mtime // 1000 / 1e6, tz=timezone.utc)
                yield path, name, self._content(path), changed, length, ""

    def _content(self, path: str) -> bytes | None:
        try:
            with self.store.open_input_stream(path) as stream:
                return stream.read()
        except OSError:
            return None


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return _Tree(self.root).pieces() or [Piece(self.root, slot=1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _Tree(self.root).all_rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch holds the files changed after the last batch's end and up to its own."""

    def __init__(self, root: str, settle: float):
        self.root, self.settle = root, settle

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _Tree(self.root).pieces(int(start["upto"]), int(end["upto"])) or [Piece(self.root, slot=1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _Tree(self.root).all_rows(partition)


class SourceTree(DataSource):
    """``load`` takes the root, a folder or a file, as a URI or a local path.

    A stream first gives all files and then, batch by batch, those whose time of
    change is later than the last batch's end; a file that is given an older time is
    not seen. Option ``settle`` (seconds) leaves files alone that have just changed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], float(self.options.get("settle", SETTLE_SECONDS)))
