"""Small files that are made whole and once: the marks by which writers agree."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """Hadoop's path and file system of ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    target, system = hadoop(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = hadoop(spark, path)
    return system.exists(target)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted, without hidden ones; none if there is no folder."""
    target, system = hadoop(spark, folder)
    found = [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []
    return sorted(x for x in found if x[0] != ".")


def read_text(spark: SparkSession, path: str) -> str:
    target, system = hadoop(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` a file with ``text``, whole, unless it exists; False if it does.

    One of several writers succeeds: a hard link on a local file system, elsewhere a rename that never
    replaces (atomic on HDFS; an object store needs a committer with conditional creation for it).
    """
    jvm = spark.sparkContext._jvm
    target, system = hadoop(spark, path)
    system.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(staged.toUri().getPath(), target.toUri().getPath())
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(staged, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Exception:
        if not system.exists(target):
            raise
        return False
    finally:
        system.delete(staged, False)
