"""Listing and reading a folder tree in tasks: a frontier of folders, level by level, ignored ones never opened.

A task opens all folders of the frontier that it is given and up to ``AT_ONCE`` for each batch of those found below them; the
others found are the next frontier, dealt anew.  So a small tree is one job, a large one spreads over all tasks however uneven
it is, and no folder waits for more rounds than the tree has levels.
Symbolic links are rows of their own and never followed.  Executors see the tree under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders found in a batch that a task opens itself, rows of a batch, and bytes of file contents in a batch.
AT_ONCE, BATCH, CONTENT = 500, 10_000, 8 << 20
ENTRY = "file_path string, kind string, length long"
_NAMES = ["file_path", "kind", "length"]


def _shown(path: str) -> str:
    """A path as text; bytes that are no UTF-8 are shown as such, and such a file can't be read."""
    return os.fsencode(path).decode("utf-8", "replace")


def _open(base: str, folder: str, ignored: frozenset[str]) -> Iterator[tuple[str, str, int | None]]:
    """(path, kind, length) of what is in a folder: file, link, ahead (a folder to open) or closed (one that can't be)."""
    try:
        with os.scandir(os.path.join(base, folder)) as found:
            for x in found:
                path = f"{folder}/{x.name}" if folder else x.name
                if x.name in ignored and x.is_dir(follow_symlinks=False):
                    continue
                if x.is_symlink():
                    yield path, "link", None
                elif x.is_dir(follow_symlinks=False):
                    yield path, "ahead", None
                elif x.is_file(follow_symlinks=False):
                    yield path, "file", x.stat(follow_symlinks=False).st_size
    except OSError:
        yield folder, "closed", None


def _walk(base: str, ignored: frozenset[str], at_once: int):
    def rows(folders: list[str]) -> Iterator[tuple[str, str, int | None]]:
        found = 0
        while folders:
            folder = folders.pop()
            yield folder, "folder", None
            for row in _open(base, folder, ignored):
                if row[1] == "ahead" and found < at_once:
                    found += 1
                    folders.append(row[0])
                else:
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda some: pa.RecordBatch.from_arrays([pa.array([_shown(r[0]) for r in some]), pa.array([r[1] for r in some]), pa.array([r[2] for r in some], pa.int64())], _NAMES)
        held = []
        for batch in batches:
            for row in rows(batch.column(0).to_pylist()):
                held.append(row)
                if len(held) == BATCH:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return run


def entries(spark: SparkSession, base: str, ignored: Sequence[str], settle: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE) -> list[DataFrame]:
    """Rows (file_path below ``base``, kind, length) of each round over the frontier, settled: files, links, folders opened
    (kind ``folder``) and folders that can't be (``closed``)."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, out = spark.createDataFrame([("",)], "file_path string").coalesce(1), []
    while True:
        level = settle(frontier.mapInArrow(_walk(base, frozenset(ignored), at_once), ENTRY))
        out.append(level)
        ahead = level.filter("kind = 'ahead'").select("file_path")
        if not ahead.head(1):
            return out
        frontier = ahead.repartition(wide, "file_path")


def contents(files: DataFrame, base: str) -> DataFrame:
    """``files`` (file_path, language, length) with ``content``, null where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, size, held = 0, 0, []
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size > CONTENT:
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, len(held)).columns, pa.array(held, pa.binary())], ["file_path", "language", "length", "content"])
                    low, size, held = i + 1, 0, []
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(low).columns, pa.array(held, pa.binary())], ["file_path", "language", "length", "content"])

    wide = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file_path", "language", "length").repartition(wide, "file_path").mapInArrow(run, "file_path string, language string, length long, content binary")


def all_of(levels: list[DataFrame], kind: str) -> DataFrame:
    """The rows of one kind of all rounds."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter(F.col("kind") == kind)
