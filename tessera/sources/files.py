"""Scanning a source tree into file rows and skip rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import IGNORED_FOLDERS, language_of, line_count
from tessera.schema import DomainError
from tessera.sources import places, tree

MAX_BYTES = 2 << 20
SNIFFED = 8192
MESSAGES = {
    "SYMLINK_FILE": "Symbolic links are not followed.",
    "FILE_TOO_LARGE": "File exceeds the size limit.",
    "READ_ERROR": "File could not be read.",
    "BINARY_FILE": "File contains NUL bytes.",
    "DECODE_ERROR": "File is not valid UTF-8.",
}


def _elsewhere(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(listed files with content, links) of a root on a file system that tasks don't see as folders: Spark's reader lists it."""
    plain = root.rstrip("/")
    # a file that is listed but can't be read gives no row where its content is asked for
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    listed = reader.load(root).withColumn("file_path", F.substring("path", F.lit(len(plain) + 2), F.length("path"))).withColumn("language", language_of(F.col("file_path")))
    folders = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    listed = listed.filter(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED_FOLDERS])))
    return listed.select("file_path", "language", "length", "content"), spark.createDataFrame([], "file_path string")


def scan(spark: SparkSession, root: str, project_id: int = 1, max_bytes: int = MAX_BYTES, settle: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, issues) of a tree: known suffixes outside ignored folders, which are never opened.

    Sizes are checked on the listing, so what is too large is never read.  The listing is settled by ``settle``
    or in the session's shared folder.
    """
    base = root.removeprefix("file://").rstrip("/") or "/"
    local = "://" not in root or root.startswith("file://")
    if local and not os.path.isdir(base):
        raise DomainError("INVALID_ROOT_PATH", f"{root} is not a folder.", 400)
    if local:
        levels = tree.entries(spark, base, IGNORED_FOLDERS, settle or (lambda df: places.settled(df, "listing")))
        rows = tree.all_of(levels, "file").withColumn("language", language_of(F.col("file_path")))
        links = tree.all_of(levels, "link").select("file_path")
    else:
        rows, links = _elsewhere(spark, root)
    rows = rows.filter(F.col("language").isNotNull())
    small = rows.filter(F.col("length") <= max_bytes)
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    head = F.substring(F.col("content"), 1, SNIFFED)
    reason = F.when(F.contains(head, F.lit(bytearray(b"\0"))), "BINARY_FILE").when(~F.is_valid_utf8(F.col("content").cast("string")), "DECODE_ERROR")
    read = (tree.contents(small, base) if local else small).withColumn("reason_code", F.when(F.col("content").isNull(), "READ_ERROR").otherwise(reason))
    files = read.filter("reason_code is null").select(
        F.lit(project_id).cast("long").alias("project_id"), "file_path", "language", line_count(text).alias("line_count"),
        F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size_bytes"), text.alias("content"),
    )
    skipped = read.filter("reason_code is not null").select("file_path", "reason_code")
    if not local:  # a file that the reader gave up has no row
        skipped = skipped.unionByName(small.select("file_path").join(read.filter("content is not null").select("file_path"), "file_path", "left_anti").select("file_path", F.lit("READ_ERROR").alias("reason_code")))
    skipped = skipped.unionByName(rows.filter(F.col("length") > max_bytes).select("file_path", F.lit("FILE_TOO_LARGE").alias("reason_code")))
    linked = links.filter(language_of(F.col("file_path")).isNotNull())
    skipped = skipped.unionByName(linked.select("file_path", F.lit("SYMLINK_FILE").alias("reason_code")))
    message = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("reason_code"))
    issues = skipped.select(F.lit(project_id).cast("long").alias("project_id"), "file_path", F.lit("skipped").alias("issue_type"), "reason_code", message.alias("message"))
    return files, issues
