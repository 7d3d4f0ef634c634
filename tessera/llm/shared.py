"""Shared folders, lineage cuts and session facts used by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.marks import drop_path, names_in, path_exists, publish, read_text

__all__ = ["drop_path", "names_in", "path_exists", "publish", "read_text"]

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


#: Folders that settle() has written in the innermost :func:`scratch` of this thread of work and nobody has dropped.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made if all runs on this machine; on a
    cluster that is an error, as executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of settled frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled", None)
        if path is not None:
            df._settled = None
            if path in (scope := _SCOPE.get() or []):
                scope.remove(path)
            drop_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what this thread settled inside, also where that fails; other threads' folders stay."""
    own: list[str] = []
    before = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in own:
            drop_path(spark, path)


def col(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column has it, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most: int = 500) -> None:
    """Fewer rows an Arrow batch, so that a batch of very long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def few(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """A one-column side of a join with texts: broadcast if it is counted and small, else hashed in a shuffled join.

    Either way the join gives the same rows; the first spares shuffling the texts.
    """
    keys = settle(keys, "keys")
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("shuffle_hash")
