"""Token counts: delta-maintained rollups with idempotent batch commits.

A batch of events (insert, delete, or revise with the old and the new count) is summed to signed
deltas of documents and tokens by source, language and tokenizer version.  The deltas are written to
a folder that only a manifest named after the batch makes part of the rollup.  The manifest is made
whole and only if there is none, so of several committers of a batch one succeeds, and a batch that
fails before leaves no trace.  Totals are maintained: after every ``every`` batches they and the new
deltas are summed to a new snapshot, published alike, and reading adds the deltas since.

Null source, language or version is a group of its own; a null count reads as 0; unknown operations
are errors; an empty batch is published as an empty delta; rows that repeat are events each; texts are
not read here; columns of events beyond those named are not read.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KEYS = ["source", "lang", "tokenizer"]
EVERY = 16
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums of ``events`` (op, source, lang, tokenizer, tokens, old_tokens)."""
    op = F.col("op")
    new, old = (F.coalesce(F.col(x).cast("long"), F.lit(0)) for x in ("tokens", "old_tokens"))
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))).cast("int"))
    change = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    rows = events.select(*[F.col(k).cast("string").alias(k) for k in KEYS], sign.cast("long").alias("docs"), change.alias("tokens"))
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


class Rollup:
    """A folder of deltas, of manifests that name the published ones, and of snapshots of the totals."""

    def __init__(self, spark: SparkSession, path: str | None = None, every: int = EVERY) -> None:
        self.spark, self.path, self.every = spark, path or shared.fresh_path(spark, "rollup"), every

    def _manifest(self, batch_id: str) -> str:
        return f"{self.path}/batches/b-{quote(batch_id, safe='')}"

    def _folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def committed(self, batch_id: str) -> bool:
        return shared.path_exists(self.spark, self._manifest(batch_id))

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Publish a batch; False if it was published before."""
        if self.committed(batch_id):
            return False
        folder = self._folder()
        deltas(events).write.parquet(folder)
        if not shared.publish(self.spark, self._manifest(batch_id), folder):
            shared.drop_path(self.spark, folder)
            return False
        if len(self._state()[3]) >= self.every:
            self.compact()
        return True

    def _state(self) -> tuple[int, list[str], list[str], list[str]]:
        """Number of the last snapshot, its folders and batches, and the batches since."""
        number, folders, done = 0, [], []
        if found := shared.names_in(self.spark, f"{self.path}/snapshots"):
            number = int(found[-1])
            last = json.loads(shared.read_text(self.spark, f"{self.path}/snapshots/{found[-1]}"))
            folders, done = [last["folder"]], last["batches"]
        known = set(done)
        return number, folders, done, [b for x in shared.names_in(self.spark, f"{self.path}/batches") if (b := unquote(x[2:])) not in known]

    def _rows(self, folders: list[str], batches: list[str]) -> DataFrame:
        folders = [*folders, *(shared.read_text(self.spark, self._manifest(b)) for b in batches)]
        return self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS)

    def compact(self) -> bool:
        """Sum the last snapshot and the deltas since to the next one; False if another was faster or nothing is new."""
        number, folders, done, new = self._state()
        if not new:
            return False
        folder = self._folder()
        _summed(self._rows(folders, new)).write.parquet(folder)
        if shared.publish(self.spark, f"{self.path}/snapshots/{number + 1:012d}", json.dumps({"folder": folder, "batches": [*done, *new]})):
            return True
        shared.drop_path(self.spark, folder)
        return False

    def totals(self) -> DataFrame:
        """docs and tokens of every group that has any: the last snapshot and the deltas since."""
        _, folders, _, new = self._state()
        return _summed(self._rows(folders, new))
