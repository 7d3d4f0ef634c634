from pyspark.sql import functions as F

from tessera.operators import events
from tessera.streaming import ledger

SCHEMA = "attempt_id string, event string, outcome string, latency_seconds double"
ROWS = [("a", "started", None, None), ("a", "finished", "success", 1.5), ("b", "started", None, None), ("c", "started", None, None), ("c", "finished", "failure", 0.5), ("d", "finished", "success", 1.0), ("e", "started", None, None), ("e", "started", None, None)]


def test_batch_states(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.attempt_id: r.state for r in events.attempts(df).collect()} == {"a": "done", "b": "pending", "c": "done", "d": "orphan", "e": "duplicate_start"}
    t = events.ledger_totals(df).first()
    assert (t.calls, t.successes, t.failures, t.pending, t.errors, t.latency_seconds) == (4, 1, 1, 1, 2, 2.0)
    responses = spark.createDataFrame([("b", 0, True, 0.1), ("z", 1, False, 0.2)], "attempt_id string, ordinal int, error boolean, latency_seconds double")
    got = {r.attempt_id: (r.verdict, r.outcome) for r in events.reconcile(df, responses).collect()}
    assert got["b"] == ("closed", "failure") and got["z"][0] == "unknown_response" and got["a"][0] == "unchanged"


def test_stream_agrees_with_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i in range(0, len(ROWS), 3):
        spark.createDataFrame(ROWS[i : i + 3], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ledger.counters(stream()).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("counters").first()
    assert (got.calls, got.successes, got.failures) == (5, 2, 1)
    q = ledger.attempt_states(stream()).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(180)
    seen = {}
    for r in spark.table("states").collect():
        seen.setdefault(r.attempt_id, []).append(r.state)
    assert "done" in seen["a"] and seen["b"] == ["pending"] and "error" in seen["e"] and seen["d"] == ["error"]
    assert df.count() == len(ROWS)


def test_append_once_is_idempotent(spark, tmp_path):
    spark.createDataFrame(ROWS[:4], SCHEMA).write.json(str(tmp_path / "in"))
    for run in ("one", "two", "three"):
        if run == "three":  # a checkpoint of its own, whose first batch has other rows
            spark.createDataFrame([("new", *ROWS[0][1:])], SCHEMA).write.mode("overwrite").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        ledger.append_once(stream, str(tmp_path / "out"), ["attempt_id"], str(tmp_path / run)).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_append_once_restarts_and_stays_flat(spark, tmp_path):
    for i in range(12):  # each file repeats half of the one before
        rows = [(f"k{i * 5 + j}", "started", None, None) for j in range(10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    first = ledger.append_once(stream(), str(tmp_path / "out"), ["attempt_id"], str(tmp_path / "c")).start()
    first.awaitTermination(240)
    batches = [p for p in first.recentProgress if p["numInputRows"]]
    assert len(batches) == 12 and all(p["numInputRows"] == 10 for p in batches)
    # what a batch reads is its own file: the sink's table isn't a source, and state is looked up by key
    assert all(len(p["stateOperators"]) == 1 and p["stateOperators"][0]["numRowsUpdated"] <= 10 for p in batches)
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == table.select("attempt_id").distinct().count() == 65
    spark.createDataFrame([("k3", "again", None, None), ("late", "started", None, None)], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    ledger.append_once(stream(), str(tmp_path / "out"), ["attempt_id"], str(tmp_path / "c")).start().awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 66


def test_windows_need_a_watermark(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("x").alias("event_type"))
    assert ledger.windowed_counts(stream).isStreaming
