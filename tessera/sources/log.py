"""An appending log of rows with gapless ordinals, for several writers.

A writer writes its rows aside first and then makes the next mark, which lists all segments of the log with the
ordinals that each begins with.  Marks are made once, so of several writers of one number a single one
succeeds and the others take the next one: ordinals follow the order of the marks, without gaps.  A writer that dies
before its mark leaves a folder that nobody lists.

Segments have levels.  When ``FAN`` of one level are there, the writer that adds to them merges them into one of
the next, sorted by the log's own columns, so the number of folders grows with the logarithm of the appends and a
reader of one key opens few row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import marks

#: Segments of a level that are merged, and marks whose segments stay readable.
FAN, KEPT = 8, 3


class AppendLog:
    """The log ``name`` below ``root``; rows have the columns of ``schema``, merged segments are sorted by ``sort``."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, sort: Sequence[str] = ()) -> None:
        self.spark, self.schema, self.sort = spark, schema, list(sort)
        self.marks, self.data = f"{root.rstrip('/')}/logs/{name}/marks", f"{root.rstrip('/')}/logs/{name}/data"

    def _state(self) -> tuple[int, list[dict]]:
        found = marks.names_in(self.spark, self.marks)
        return (int(found[-1]), self._segments(found[-1])) if found else (0, [])

    def _segments(self, mark: str) -> list[dict]:
        return json.loads(marks.read_text(self.spark, f"{self.marks}/{mark}"))

    def size(self) -> int:
        """Rows in the log, which is its last ordinal."""
        return sum(s["rows"] for s in self._state()[1])

    def append(self, rows: Sequence[tuple]) -> int:
        """Add rows of the driver; returns the first one's ordinal."""
        table = self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"position long, {self.schema}")
        return self._add(table.coalesce(1), len(rows))

    def append_table(self, table: DataFrame, order: str) -> int:
        """Add a table's rows in the order of ``order``, whose values differ; returns the first one's ordinal."""
        from tessera.operators.term_index import slotted

        numbered = slotted(table, order).withColumn("position", F.col("slot"))
        names = [f.split()[0] for f in self.schema.split(", ")]
        return self._add(numbered.select("position", *names), None)

    def _add(self, table: DataFrame, rows: int | None) -> int:
        path = f"{self.data}/{uuid.uuid4().hex}"
        table.write.parquet(path)
        rows = self.spark.read.parquet(path).count() if rows is None else rows
        while True:
            number, segments = self._state()
            first = sum(s["rows"] for s in segments) + 1
            after, made = self._merged([*segments, {"path": path, "first": first, "rows": rows, "level": 0}])
            if marks.publish(self.spark, f"{self.marks}/{number + 1:012d}", json.dumps(after)):
                self._clean(number + 1)
                return first
            for m in made:
                marks.drop_path(self.spark, m)

    def _merged(self, segments: list[dict]) -> tuple[list[dict], list[str]]:
        """The segments after merging levels that are full, and the folders made for it."""
        made = []
        while len(segments) >= FAN and len({s["level"] for s in segments[-FAN:]}) == 1:
            last = segments[-FAN:]
            path, first = f"{self.data}/{uuid.uuid4().hex}", last[0]["first"]
            whole = self._read(last).withColumn("position", F.col("ordinal") - first).drop("ordinal")
            order = [*self.sort, "position"]
            whole.repartitionByRange(max(1, sum(s["rows"] for s in last) >> 20), *order).sortWithinPartitions(*order).write.parquet(path)
            made.append(path)
            segments = [*segments[:-FAN], {"path": path, "first": first, "rows": sum(s["rows"] for s in last), "level": last[0]["level"] + 1}]
        return segments, made

    def _clean(self, number: int) -> None:
        """Drop marks before the last ones and the segments that only they list."""
        found = marks.names_in(self.spark, self.marks)
        old = [m for m in found if int(m) <= number - KEPT]
        if not old:
            return
        listed = lambda some: {s["path"] for m in some for s in self._segments(m)}
        try:
            gone = listed(old) - listed(m for m in found if int(m) > number - KEPT)
        except Exception:  # another writer is cleaning the same marks
            return
        for path in [*gone, *(f"{self.marks}/{m}" for m in old)]:
            marks.drop_path(self.spark, path)

    def _read(self, segments: list[dict]) -> DataFrame:
        out = None
        for s in segments:
            part = self.spark.read.schema(f"position long, {self.schema}").parquet(s["path"])
            part = part.select((F.col("position") + s["first"]).alias("ordinal"), *part.columns[1:])
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"ordinal long, {self.schema}") if out is None else out

    def read(self, where: Column | None = None) -> DataFrame:
        """``ordinal`` from 1 and the rows' columns; a segment is one branch of the plan."""
        rows = self._read(self._state()[1])
        return rows if where is None else rows.filter(where)

    def segments(self) -> int:
        return len(self._state()[1])


RESPONSES = (
    "case_id string, attempt_id string, phase string, error boolean, usage_available boolean, prompt_tokens long, completion_tokens long, total_tokens long, "
    "requested_model string, returned_model string, returned_model_version string, provider_latency_seconds double"
)


class ResponseLog(AppendLog):
    """Durable responses of a model: each call is recorded, with its place among all calls, before its answer is used."""

    def __init__(self, spark: SparkSession, root: str, run: str) -> None:
        super().__init__(spark, root, f"responses-{run}", RESPONSES, ["case_id"])

    def record(self, case_id: str, attempt_id: str, phase: str, *, error: bool = False, usage: tuple[int, int, int] | None = None, requested: str | None = None, returned: str | None = None, version: str | None = None, seconds: float = 0.0) -> int:
        """Record one call and return its ordinal."""
        return self.append([(case_id, attempt_id, phase, error, usage is not None, *(usage or (None, None, None)), requested, returned, version, seconds)])

    def calls(self) -> DataFrame:
        """The recorded calls with ``call_ordinal`` from 1, as the evaluation operators take them."""
        return self.read().withColumnRenamed("ordinal", "call_ordinal")
