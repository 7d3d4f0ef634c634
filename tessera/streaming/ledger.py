"""Streaming forms of the attempt ledger (batch semantics: ``operators.events``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.marks import names_in

STATE = "started int, finished int, outcome string, latency double"
OUTPUT = "attempt_id string, state string, outcome string, latency_seconds double"


def _step(key, batches: Iterator, state):
    """An attempt's state after a batch: emitted once done, pending or wrong."""
    import pandas as pd

    started, finished, outcome, latency = state.get if state.exists else (0, 0, None, 0.0)
    for rows in batches:
        started += int((rows["event"] == "started").sum())
        ends = rows[rows["event"] == "finished"]
        finished += len(ends)
        if len(ends):
            outcome = ends["outcome"].iloc[-1]
            latency += float(ends["latency_seconds"].fillna(0).sum())
    state.update((started, finished, outcome, latency))
    bad = started != 1 or finished > 1
    name = "error" if bad and (started > 1 or finished > started) else "done" if finished == 1 else "pending"
    yield pd.DataFrame({"attempt_id": [key[0]], "state": [name], "outcome": [outcome], "latency_seconds": [latency]})


def attempt_states(stream: DataFrame) -> DataFrame:
    """The state of each attempt after every micro-batch that touches it (update mode)."""
    return stream.groupBy("attempt_id").applyInPandasWithState(_step, OUTPUT, STATE, "update", "NoTimeout")


def counters(stream: DataFrame) -> DataFrame:
    """Running calls, successes, failures and latency (complete mode)."""
    done = F.col("event") == "finished"
    return stream.agg(
        F.count_if(F.col("event") == "started").alias("calls"), F.count_if(done & (F.col("outcome") == "success")).alias("successes"),
        F.count_if(done & (F.col("outcome") == "failure")).alias("failures"), F.coalesce(F.sum(F.when(done, F.col("latency_seconds"))), F.lit(0.0)).alias("latency_seconds"),
    )


class _FirstOfKey(StatefulProcessor):
    """Passes the first row of each key that was never seen; what is in the table at the first start counts as seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if not self.seen.exists():
            for some in rows:
                if len(some):
                    self.seen.update((True,))
                    yield some.head(1)
                    return

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that appends rows whose keys aren't in ``path`` yet; replayed batches add nothing.

    The keys are state of the query, in RocksDB, so a micro-batch looks up its own keys and nothing else however long the
    history is.  A new checkpoint takes the table's keys as its first state, once; one query at a time
    appends to a table.  Each micro-batch has a folder of its own, ``batch=<checkpoint>-<id>``, which a replay overwrites.
    """
    spark = stream.sparkSession
    own = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    there = names_in(spark, path)
    if any(x.startswith(f"batch={own}-") for x in there):  # this query's own keys are in its checkpoint
        there = [x for x in there if not x.startswith(f"batch={own}-")]
    found = [f"{path}/{x}" for x in there if x.startswith("batch=")]
    known = spark.read.schema(stream.schema).parquet(*found) if found else spark.createDataFrame([], stream.schema)
    new = stream.groupBy(*keys).transformWithStateInPandas(
        _FirstOfKey(), outputStructType=stream.schema, outputMode="append", timeMode="none", initialState=known.select(*keys).distinct().groupBy(*keys)
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={own}-{number}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An addition of this engine: counts by event type in event-time windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
