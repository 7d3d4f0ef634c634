"""Attempt ledgers: started and finished events of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attempts(events: DataFrame, *keys: str) -> DataFrame:
    """One row for each attempt (attempt_id, event, outcome, latency_seconds): its counts, outcome and state."""
    on = lambda e: F.count_if(F.col("event") == e)
    done = F.when(F.col("event") == "finished", F.col("outcome"))
    late = F.when(F.col("event") == "finished", F.col("latency_seconds"))
    out = events.groupBy("attempt_id", *keys).agg(on("started").alias("starts"), on("finished").alias("finishes"), F.max(done).alias("outcome"), F.sum(late).alias("latency_seconds"))
    state = (
        F.when(F.col("starts") > 1, "duplicate_start").when(F.col("starts") == 0, "orphan").when(F.col("finishes") > 1, "duplicate_finish")
        .when(F.col("finishes") == 0, "pending").when(~F.col("outcome").isin("success", "failure") | (F.col("latency_seconds") < 0), "invalid").otherwise("done")
    )
    return out.withColumn("state", state)


def ledger_totals(events: DataFrame, *keys: str) -> DataFrame:
    """calls, successes, failures, pending, errors and latency of all attempts."""
    rows = attempts(events, *keys)
    done = F.col("state") == "done"
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("starts") > 0).alias("calls"), F.count_if(done & (F.col("outcome") == "success")).alias("successes"),
        F.count_if(done & (F.col("outcome") == "failure")).alias("failures"), F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(~F.col("state").isin("done", "pending")).alias("errors"), F.coalesce(F.sum(F.when(done, F.col("latency_seconds"))), F.lit(0.0)).alias("latency_seconds"),
    )


def pending(events: DataFrame) -> DataFrame:
    """Starts without a finish."""
    return events.filter("event = 'started'").join(events.filter("event = 'finished'").select("attempt_id"), "attempt_id", "left_anti")


def audit(events: DataFrame, recorded: DataFrame) -> DataFrame:
    """Differences between a ledger's totals and the recorded ones (calls, successes, failures)."""
    t = ledger_totals(events)
    both = t.crossJoin(recorded.select(*[F.col(c).alias(f"r_{c}") for c in ("calls", "successes", "failures")]))
    checks = [F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("ledger"), F.col(f"r_{c}").cast("long").alias("recorded")) for c in ("calls", "successes", "failures")]
    checks.append(F.struct(F.lit("pending").alias("field"), F.col("pending").cast("long").alias("ledger"), F.lit(0).cast("long").alias("recorded")))
    return both.select(F.inline(F.array(*checks))).filter("ledger <> recorded")


def append_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys aren't there yet, each key once."""
    return new.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def reconcile(ledger: DataFrame, responses: DataFrame) -> DataFrame:
    """Pending attempts closed from durable responses (attempt_id, ordinal, error, latency_seconds); gaps and strangers are errors."""
    rows = attempts(ledger).select("attempt_id", "state")
    follows = responses.select((F.col("ordinal") + 1).alias("ordinal")).distinct().withColumn("follows", F.lit(True))
    again = F.row_number().over(Window.partitionBy("ordinal").orderBy("attempt_id")) > 1
    marked = responses.withColumn("again", again).join(follows, "ordinal", "left")
    marked = marked.withColumn("gap", F.col("again") | ((F.col("ordinal") != 0) & F.col("follows").isNull()))
    out = rows.join(marked, "attempt_id", "full_outer")
    verdict = (
        F.when(F.col("state").isNull(), "unknown_response").when(F.col("gap"), "ordinal_gap")
        .when((F.col("state") == "pending") & F.col("ordinal").isNull(), "missing_response").when(F.col("state") == "pending", "closed").otherwise("unchanged")
    )
    outcome = F.when(verdict == "closed", F.when(F.col("error"), "failure").otherwise("success"))
    return out.select("attempt_id", verdict.alias("verdict"), outcome.alias("outcome"), "latency_seconds")
