"""Versioned tables by project: data is written aside, and one mark publishes a version."""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import stable_key
from tessera.schema import DomainError
from tessera.sources import marks

#: Versions that stay readable after newer ones, for readers that began with them.
KEPT = 3
#: Seconds after which a scan's lock counts as left behind by a process that died.
LEASE = 6 * 3600


class Store:
    """Tables of projects below ``root``.

    A version is a numbered mark that lists each table's folders.  Marks are made once, so of several
    writers of one number a single one succeeds; the others take the next number or, with
    ``expected``, are told.  Readers see the old version until the new mark is there, a failure
    before that leaves the old one in place, and the last ``KEPT`` versions' folders stay.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _marks(self, project) -> str:
        return f"{self.root}/marks/{project}"

    def version(self, project) -> int:
        """Number of the last version, 0 without one."""
        found = marks.names_in(self.spark, self._marks(project))
        return int(found[-1]) if found else 0

    def _tables(self, project, number: int) -> dict[str, list[str]]:
        return json.loads(marks.read_text(self.spark, f"{self._marks(project)}/{number:012d}")) if number else {}

    def has(self, project, table: str | None = None) -> bool:
        number = self.version(project)
        return number > 0 and (table is None or table in self._tables(project, number))

    def publish(self, project, tables: dict[str, DataFrame], keep: bool = False, more: dict[str, DataFrame] | None = None, expected: int | None = None, written: dict[str, str] | None = None) -> int:
        """Replace a project's tables; returns the new version.

        With ``keep`` tables that aren't named stay as they are, without being copied; the rows of ``more``
        are added to a table; ``written`` names tables whose folders are there already (:meth:`folder`).  With ``expected`` the write is a conflict unless that is still the last version.
        """
        folder = self.folder(project)
        for name, df in [*tables.items(), *(more or {}).items()]:
            df.write.parquet(f"{folder}/{name}")
        while True:
            now = self.version(project)
            if expected is not None and now != expected:
                marks.drop_path(self.spark, folder)
                raise DomainError("WRITE_CONFLICT", f"Project {project} was changed by another writer.", 409)
            before = self._tables(project, now)
            after = (dict(before) if keep or more else {}) | {name: [f"{folder}/{name}"] for name in tables}
            after |= {name: [path] for name, path in (written or {}).items()}
            for name in more or {}:
                after[name] = [*after.get(name, []), f"{folder}/{name}"]
            if marks.publish(self.spark, f"{self._marks(project)}/{now + 1:012d}", json.dumps(after)):
                self._clean(project, now + 1)
                return now + 1

    def folder(self, project) -> str:
        """A new folder for tables that are written before they are published."""
        return f"{self.root}/data/{project}/{uuid.uuid4().hex}"

    def _clean(self, project, number: int) -> None:
        """Drop versions before the last ones, and the folders that only they list."""
        found = [int(x) for x in marks.names_in(self.spark, self._marks(project))]
        old, new = [x for x in found if x <= number - KEPT], [x for x in found if x > number - KEPT]
        if not old:
            return
        used = {f for x in new for folders in self._tables(project, x).values() for f in folders}
        for x in old:
            for folders in self._tables(project, x).values():
                for f in folders:
                    if f not in used:
                        marks.drop_path(self.spark, f)
            marks.drop_path(self.spark, f"{self._marks(project)}/{x:012d}")

    def read(self, project, table: str) -> DataFrame:
        tables = self._tables(project, self.version(project))
        if table not in tables:
            raise DomainError("PROJECT_NOT_SCANNED", f"Project {project} has no {table}.", 409)
        return self.spark.read.parquet(*tables[table])

    def path(self, project, table: str) -> str:
        """The one folder of a table that was written before it was published."""
        return self._tables(project, self.version(project))[table][0]

    def settle(self, df: DataFrame) -> DataFrame:
        """``df`` written below the root and read back; :meth:`unsettle` removes it."""
        path = f"{self.root}/work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._settled = path
        return out

    def unsettle(self, *frames: DataFrame) -> None:
        for df in frames:
            marks.drop_path(self.spark, df._settled)

    def delete(self, project) -> None:
        marks.drop_path(self.spark, self._marks(project))
        marks.drop_path(self.spark, f"{self.root}/data/{project}")

    @contextmanager
    def scanning(self, project):
        """One scan of a project at a time, whichever process asks; a second one is refused, not queued.

        The lock holds a token and is renewed by beats while the scan runs.  A lock without a beat for a lease may
        be taken over, by the one process that makes the mark for that; an owner drops the lock only while
        it holds its own token.
        """
        path, token = f"{self.root}/locks/{project}", uuid.uuid4().hex
        beats = f"{self.root}/beats/{project}"
        taken = marks.publish(self.spark, path, f"{token} {time.time()}")
        if not taken and (old := self._lock(path)) is not None:
            seen = [float(x.split("-", 1)[1]) for x in marks.names_in(self.spark, beats) if x.startswith(old[0])]
            if max([old[1], *seen]) < time.time() - LEASE and marks.publish(self.spark, f"{self.root}/takeovers/{project}-{old[0]}", token):
                marks.drop_path(self.spark, path)
                taken = marks.publish(self.spark, path, f"{token} {time.time()}")
        if not taken:
            raise DomainError("SCAN_ALREADY_RUNNING", f"Project {project} is being scanned.", 409)
        done = threading.Event()

        def beat() -> None:
            while not done.wait(LEASE / 6):
                marks.publish(self.spark, f"{beats}/{token}-{time.time()}", "")

        threading.Thread(target=beat, daemon=True).start()
        try:
            yield
        finally:
            done.set()
            if (now := self._lock(path)) is not None and now[0] == token:
                marks.drop_path(self.spark, path)
                marks.drop_path(self.spark, beats)

    def _lock(self, path: str) -> tuple[str, float] | None:
        """Token and time of a lock that is there."""
        try:
            token, _, since = marks.read_text(self.spark, path).rpartition(" ") if marks.path_exists(self.spark, path) else ("", "", "")
        except Exception:  # dropped meanwhile
            return None
        return (token or "none", float(since)) if since else None


def numbered(store: Store, df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df``, settled, with a number from 1 in ``order``: rows are sorted in ranges and counted by range,
    so no task holds more than a range.  Rows alike in ``order`` follow in any sequence."""
    ranges = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = store.settle(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range_", F.spark_partition_id()).withColumn("inside_", inside))
    sizes = [(r["range_"], r["n"]) for r in parts.groupBy("range_").agg(F.count("*").alias("n")).collect()]  # one row a range
    before, total = {}, 0
    for number, n in sorted(sizes):
        before[number], total = total, total + n
    start = F.element_at(F.array(*[F.lit(before.get(i, 0)) for i in range(max(before, default=0) + 1)]), F.col("range_") + 1)
    out = parts.withColumn(name, (start + F.col("inside_") + 1).cast("long")).drop("range_", "inside_")
    out._settled = parts._settled
    return out


def check_vectors(vectors: DataFrame, chunks: int | None = None) -> int:
    """The one dimension of all vectors; errors for none, empty, differing or missing ones."""
    n, low, high = vectors.agg(F.count("*"), F.min(F.coalesce(F.size("embedding"), F.lit(0))), F.max(F.coalesce(F.size("embedding"), F.lit(0)))).first()
    if not n or (chunks is not None and n != chunks):
        raise ValueError(f"{n} vectors for {chunks} chunks")
    if low != high or low < 1:
        raise ValueError("vectors need one dimension above zero")
    return low


def snapshot(files: DataFrame, entities: DataFrame, relations: DataFrame, issues: DataFrame, repo: str, commit: str) -> dict[str, DataFrame]:
    """Ordered export tables; entities get a stable key and a content hash, relations stable keys at both ends."""
    key = stable_key(F.lit(repo), F.lit(commit), F.col("file_path"), F.col("entity_type"), F.col("qualified_name"), F.col("start_line"), F.col("end_line"))
    keyed = entities.withColumn("stable_entity_key", key).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    ends = relations
    for side in ("source", "target"):
        ends = ends.join(keyed.select(F.col("id").alias(f"{side}_id"), F.col("stable_entity_key").alias(f"{side}_key")), f"{side}_id")
    return {
        "code_files": files.select("file_path", "language", "line_count").orderBy("file_path"),
        "code_entities": keyed.select("stable_entity_key", "entity_type", "name", "qualified_name", "file_path", "start_line", "end_line", "content_hash").orderBy("file_path", "start_line", "stable_entity_key"),
        "code_relations": ends.select("relation_type", "source_key", "target_key", "confidence").orderBy("relation_type", "source_key", "target_key"),
        "scan_issues": issues.select("file_path", "issue_type", "reason_code", "message").orderBy("file_path", "reason_code"),
    }


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def attest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def write_report(df: DataFrame, output: str, inputs: list[str]) -> None:
    """Write a report as JSON; an output that is one of its inputs is refused.

    It is written aside and renamed, so a failure leaves the last report whole.
    """
    spark, output = df.sparkSession, output.rstrip("/")
    if output in {p.rstrip("/") for p in inputs}:
        raise ValueError(f"{output} is an input of this report")
    staged, old = f"{output}.{uuid.uuid4().hex}.new", f"{output}.{uuid.uuid4().hex}.old"
    df.write.json(staged)
    target, system = marks.hadoop(spark, output)
    if system.exists(target):
        system.rename(target, marks.hadoop(spark, old)[0])
    if not system.rename(marks.hadoop(spark, staged)[0], target):
        system.rename(marks.hadoop(spark, old)[0], target)
        raise OSError(f"{output} could not be replaced")
    marks.drop_path(spark, old)


def render_report(title: str, rows: list[dict]) -> str:
    """A Markdown table of a few collected rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    heads = list(rows[0])
    lines = [f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}"]
    lines += [f"| {' | '.join(json.dumps(r[h], ensure_ascii=False, default=str) if not isinstance(r[h], str) else r[h] for h in heads)} |" for r in rows]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"
