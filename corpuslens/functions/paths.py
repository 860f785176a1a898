"""Path tests and path order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that count as source files.
SOURCE_EXTENSIONS = [".h", ".hh", ".hpp", ".hxx", ".c", ".cc", ".cpp", ".cxx"]

# Directories that are never entered.
SKIPPED_DIRECTORIES = [
    ".git",
    ".idea",
    ".vscode",
    "build",
    "cmake-build-debug",
    "cmake-build-release",
    "venv",
    "__pycache__",
]


def extension(path: Column) -> Column:
    """Last suffix with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]*)$", 1)


def is_source_file(path: Column) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS)


def in_skipped_directory(relative_path: Column) -> Column:
    """True when a directory below the root has one of the skipped names."""
    return F.arrays_overlap(
        F.split(F.regexp_replace(relative_path, r"/?[^/]*$", ""), "/", -1),
        F.array(*[F.lit(name) for name in SKIPPED_DIRECTORIES]),
    )


def path_order(path: Column) -> Column:
    """Sort key: paths compare part by part, not character by character."""
    return F.split(path, "/", -1)
