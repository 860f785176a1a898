"""Source trees and text tables as rows ``path, relative_path, content, mtime, length``."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import SKIPPED_DIRECTORIES, in_skipped_directory, is_source_file
from corpuslens.operators.storage import materialised, qualified

ENTRIES = "path string, kind string, mtime timestamp, length bigint, warning string"
FILES = "path string, relative_path string, content binary, mtime timestamp, length bigint"


BYTES_PER_TASK = 256 * 1024 * 1024
ENTRIES_AT_ONCE = 10_000
BYTES_AT_ONCE = 8 * 1024 * 1024  # contents that are handed on together; a larger file goes alone
TASKS_PER_CORE = 2
# Beginnings of the warnings about entries that cannot be looked at, and folders that cannot be listed to their end.
NO_METADATA = "Filesystem metadata failed at "
NO_TRAVERSAL = "Unable to continue directory traversal after "


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a root, which may be a URI or a local path."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


Entry = tuple[str, str, int | None, int, str]


def _described(info: fs.FileInfo) -> Entry:
    kinds = {fs.FileType.Directory: "directory", fs.FileType.File: "file", fs.FileType.NotFound: "missing"}
    return info.path, kinds.get(info.type, "other"), info.mtime_ns, max(info.size or 0, 0), ""


def _local_entry(entry: os.DirEntry) -> Entry:
    """A link to a file is the file; a link to a folder is not entered; one that leads nowhere is a warning."""
    try:
        about = entry.stat()
    except OSError as error:
        return entry.path, "missing", None, 0, f"{NO_METADATA}{entry.path}: {error.strerror}"
    kind = "other"
    if stat.S_ISDIR(about.st_mode):
        kind = "link" if entry.is_symlink() else "directory"
    elif stat.S_ISREG(about.st_mode):
        kind = "file"
    return entry.path, kind, about.st_mtime_ns, about.st_size, ""


def _listed(store: fs.FileSystem, folder: str, wanted: Callable[[str], bool] | None = None) -> Iterator[Entry]:
    """The entries of one folder; one without permission has none, and any other trouble is a warning.

    With ``wanted`` only the entries whose paths it takes are looked at.
    """
    try:
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as entries:
                yield from (_local_entry(e) for e in entries if wanted is None or wanted(e.path))
        else:
            found = map(_described, store.get_file_info(fs.FileSelector(folder)))
            yield from (e for e in found if wanted is None or wanted(e[0]))
    except PermissionError:
        return
    except OSError as error:
        yield folder, "broken", None, 0, f"{NO_TRAVERSAL}{folder}: {error.strerror or error}"


def _may_be_folder(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


def _folders_and_count(store: fs.FileSystem, folder: str) -> tuple[list[str], int]:
    """Paths of a folder's folders, and how many other entries it has. Local files are counted by name alone."""
    folders, count = [], 0
    if not isinstance(store, fs.LocalFileSystem):
        for path, kind, *_ in _listed(store, folder):
            if kind == "directory":
                folders.append(path)
            else:
                count += 1
        return folders, count
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if _may_be_folder(entry) and _local_entry(entry)[1] == "directory":
                    folders.append(entry.path)
                else:
                    count += 1
    except PermissionError:
        pass
    except OSError:
        count += 1
    return folders, count


def _entries(found: Iterable[Entry]) -> pd.DataFrame:
    frame = pd.DataFrame(list(found), columns=["path", "kind", "mtime", "length", "warning"])
    frame["mtime"] = pd.to_datetime(frame["mtime"]).dt.floor("us")
    return frame


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Entries below ``root``, level by level; skipped directories and links to folders are not entered.

    The built-in file reader leaves out empty files and names that start with a
    dot or an underscore, so the folders of a level are listed by tasks here.
    There is one small job per level of the tree; a folder's entries come in pieces.
    """
    root = qualified(spark, root)
    _, top = open_store(root)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = open_store(root)
        for batch in batches:
            # Many small folders make one piece, a large one several.
            found = chain.from_iterable(_listed(files, path) for path in batch["path"])
            while piece := list(islice(found, ENTRIES_AT_ONCE)):
                yield _entries(piece)

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    level = spark.createDataFrame([(top.rstrip("/"),)], "path string")
    levels = []
    while True:
        found = materialised(level.mapInPandas(children, ENTRIES))
        levels.append(found)
        level = found.filter((F.col("kind") == "directory") & ~name.isin(SKIPPED_DIRECTORIES)).select(
            "path"
        )
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism)
    entries = levels[0]
    for more in levels[1:]:
        entries = entries.unionByName(more)
    return entries


def traversal_warnings(entries: DataFrame, project: str) -> DataFrame:
    """What could not be listed, as rows of :func:`corpuslens.operators.analysis.diagnostics`."""
    return entries.where(F.col("warning") != "").select(
        F.lit(project).alias("project"), "path", F.lit("traverse").alias("stage"), F.col("warning").alias("message")
    )


def _with_content(root: str, files: DataFrame) -> DataFrame:
    _, top = open_store(root)
    skip = len(top.rstrip("/")) + 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = open_store(root)

        def content(path: str) -> bytes | None:
            try:
                with store.open_input_stream(path) as stream:
                    return stream.read()
            except OSError:
                return None

        def made(rows: pd.DataFrame, contents: list[bytes | None]) -> pd.DataFrame:
            # Of plain objects, so that bytes and nulls stay what they are.
            whole = rows.assign(relative_path=rows["path"].str[skip:], content=pd.Series(contents, rows.index, object))
            return whole[["path", "relative_path", "content", "mtime", "length"]]

        for batch in batches:
            # A few megabytes at a time, so that a batch of large files is never held whole.
            contents, start, held = [], 0, 0
            for at, (path, length) in enumerate(zip(batch["path"], batch["length"], strict=True)):
                if contents and held + length > BYTES_AT_ONCE:
                    yield made(batch.iloc[start:at], contents)
                    contents, start, held = [], at, 0
                contents.append(content(path))
                held += max(length, len(contents[-1] or b""))
            if contents:
                yield made(batch.iloc[start:], contents)

    return files.mapInPandas(read, FILES)


def scan_code_files(spark: SparkSession, root: str, entries: DataFrame | None = None) -> DataFrame:
    """Source files below ``root``; a file that cannot be read has null content.

    Names are filtered before any content is read. A root that is a file is read by
    :func:`scan_single_file`; one that is not there is an error. ``entries`` may hand
    in what :func:`list_tree` gave for the same root.
    """
    root = qualified(spark, root)
    store, top = open_store(root)
    about = store.get_file_info(top)
    if about.type == fs.FileType.File:
        return scan_single_file(spark, root)
    if about.type != fs.FileType.Directory:
        raise FileNotFoundError(f"Unable to traverse {root}: no such folder")
    listed = list_tree(spark, root) if entries is None else entries
    found = listed.filter((F.col("kind") == "file") & is_source_file(F.col("path")))
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // BYTES_PER_TASK)
    return _with_content(root, found.select("path", "mtime", "length").repartition(tasks))


def scan_single_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a root: no rows, and no error, when it is not a source file."""
    path = qualified(spark, path)
    store, plain = open_store(path)
    found = spark.createDataFrame(_entries([_described(store.get_file_info(plain))]), ENTRIES)
    kept = found.filter((F.col("kind") == "file") & is_source_file(F.col("path")))
    return _with_content(path.rsplit("/", 1)[0], kept.select("path", "mtime", "length"))


def spread(files: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores.

    A table comes in pieces of bytes, so the many short rows of one may be a single
    piece, while what is done with them costs time for each row.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(TASKS_PER_CORE * cores, files.rdd.getNumPartitions()))


def filter_source_rows(files: DataFrame, relative_path: Column) -> DataFrame:
    """The same two filters for files that are kept in a table."""
    return files.filter(is_source_file(relative_path) & ~in_skipped_directory(relative_path))


# The reasons given for bytes that are no UTF-8, and for no bytes at all.
NOT_UTF8 = "File content is not valid UTF-8"
NOT_READ = "File content could not be read"


def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text`` and ``parse_error``; a bad file is a row, not a failed job.

    Bytes that are no UTF-8 are read as Latin-1, which keeps every byte, so hash
    and rules follow what the file holds. A file that cannot be read has null text.
    """
    decoded = F.col(content).cast("string")
    valid = F.is_valid_utf8(decoded)
    return files.withColumn(
        "parse_error",
        F.when(F.col(content).isNull(), NOT_READ)
        .when(~valid, NOT_UTF8)
        .otherwise(""),
    ).withColumn("text", F.when(valid, decoded).otherwise(F.decode(F.col(content), "ISO-8859-1")))
