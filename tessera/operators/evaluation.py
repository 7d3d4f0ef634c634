"""Evaluation runs: eligible cases, gold joined with predictions, and what is measured over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import any_hit, micro, reciprocal_rank

# States and layers of evaluation cases, phases of responses.
ACCEPTED_GOLD = ("machine_verified", "human_verified")
CANONICAL_GOLD = ("machine_verified",)
RUNNABLE = ("executable", "executed")
PHASES = ("initial", "repair")
CUTOFFS = (1, 5, 10)


def exclusion_reason(layer: str | None = "retrieval", gold: Sequence[str] = ACCEPTED_GOLD) -> Column:
    """Why a case (gold_status, review_status, execution_status, evaluation_layers) takes no part; null if it does."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reason = F.when(~text("gold_status").isin(*gold), F.concat(F.lit("gold_status="), text("gold_status")))
    reason = reason.when(text("review_status") != "accepted", F.concat(F.lit("review_status="), text("review_status")))
    reason = reason.when(~text("execution_status").isin(*RUNNABLE), F.concat(F.lit("execution_status="), text("execution_status")))
    if layer is not None:
        reason = reason.when(~F.coalesce(F.array_contains("evaluation_layers", layer), F.lit(False)), f"no_{layer}_layer")
    return reason


def gold_join(gold: DataFrame, predictions: DataFrame, key: str = "question_id") -> DataFrame:
    """Every gold row with its prediction's ``predicted``; without one that is empty and ``matched`` false."""
    found = predictions.select(key, "predicted", F.lit(True).alias("matched"))
    out = gold.join(found, key, "left")
    return out.withColumn("predicted", F.when(F.col("predicted").isNull(), F.array()).otherwise(F.col("predicted"))).withColumn("matched", F.coalesce("matched", F.lit(False)))


def splits(joined: DataFrame, *keys: str) -> DataFrame:
    """Overall, answerable and unanswerable rows of :func:`gold_join` (gold, predicted, matched, answerable): their
    number, hit rates, mean reciprocal rank, rows without a prediction and the share with any hit."""
    can = F.coalesce(F.col("answerable"), F.lit(True))
    names = F.explode(F.array(F.lit("overall"), F.when(can, "answerable").otherwise("unanswerable")))
    rows = joined.select(
        *keys, names.alias("split"), (~F.col("matched")).cast("int").alias("lost"), (F.size("predicted") > 0).cast("double").alias("nonempty"),
        *[any_hit(F.col("predicted"), F.col("gold"), k).alias(f"r{k}") for k in CUTOFFS], reciprocal_rank(F.col("predicted"), F.col("gold")).alias("mrr"),
    )
    return rows.groupBy(*keys, "split").agg(F.count("*").alias("n"), *[F.avg(f"r{k}").alias(f"r{k}") for k in CUTOFFS], F.avg("mrr").alias("mrr"), F.sum("lost").alias("unmatched"), F.avg("nonempty").alias("nonempty_rate"))


def unanswerable_diagnostics(records: DataFrame) -> DataFrame:
    """By variant over records (variant, status, predicted, answerable): failures of all, and of the unanswerable
    ones their number, share with hits and share of errors."""
    bad, no = F.coalesce(F.col("status") != "ok", F.lit(True)), ~F.coalesce(F.col("answerable"), F.lit(True))
    share = lambda x: F.coalesce(F.round(F.avg(F.when(no, x.cast("double"))), 4), F.lit(0.0))
    return records.groupBy("variant").agg(F.count_if(bad).alias("failures"), F.count_if(no).alias("n"), share(F.coalesce(F.size("predicted"), F.lit(0)) > 0).alias("nonempty_hit_rate"), share(bad).alias("error_rate"))


def graph_measures(records: DataFrame) -> DataFrame:
    """By variant over records (variant, nodes, gold_nodes, edges, gold_edges): micro precision and recall of nodes and
    edges, the share of records that hold their whole chain, and the share of edges that aren't gold."""
    whole = (F.size(F.array_except("gold_nodes", "nodes")) == 0) & (F.size(F.array_except("gold_edges", "edges")) == 0)
    n = records.groupBy("variant").agg(F.count("*").alias("n"), F.avg(whole.cast("double")).alias("complete_chain_rate"))
    rename = lambda df, kind: df.select("variant", F.col("precision").alias(f"{kind}_precision"), F.col("recall").alias(f"{kind}_recall"))
    out = n.join(rename(micro(records, "nodes", "gold_nodes", "variant"), "node"), "variant").join(rename(micro(records, "edges", "gold_edges", "variant"), "edge"), "variant")
    said = records.groupBy("variant").agg(F.sum(F.size(F.array_distinct("edges"))).alias("said"))
    return out.join(said, "variant").withColumn("non_gold_edge_rate", F.when(F.col("said") > 0, 1 - F.col("edge_precision")).otherwise(0.0)).drop("said")


def change_plan_files(records: DataFrame, *keys: str) -> DataFrame:
    """Precision and recall of planned files (predicted) against those to change (positive), and the share of planned
    files that are among those that should not change (negative)."""
    rows = records.select(*keys, F.array_distinct("predicted").alias("predicted"), F.array_distinct("positive").alias("positive"), F.array_distinct("negative").alias("negative"))
    rate = lambda a, b: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), 4)).otherwise(0.0)
    hit, wrong = F.size(F.array_intersect("predicted", "positive")), F.size(F.array_intersect("predicted", "negative"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rate(hit, F.size("predicted")).alias("positive_precision"), rate(hit, F.size("positive")).alias("positive_recall"), rate(wrong, F.size("predicted")).alias("violation_rate"),
    )


def source_only(gold: DataFrame, observed: DataFrame, variants: Sequence[str]) -> DataFrame:
    """For each component and variant, whether gold items (component, key, question_id, indexed) that aren't in the
    index turned up among the observed (variant, component, key), how many, and in how many questions."""
    spark = gold.sparkSession
    missing = gold.filter("not indexed").groupBy("component", "key").agg(F.max("question_id").alias("question_id"))
    seen = observed.select("variant", "component", "key").distinct().join(missing, ["component", "key"])
    counts = seen.groupBy("component", "variant").agg(F.count("*").alias("observed_count"), F.count_distinct("question_id").alias("questions"))
    cells = missing.groupBy("component").agg(F.count("*").alias("gold_count")).join(F.broadcast(spark.createDataFrame([(v,) for v in variants], "variant string")))
    out = cells.join(counts, ["component", "variant"], "left").na.fill(0, ["observed_count", "questions"])
    return out.withColumn("status", F.when(F.col("observed_count") > 0, "observed").otherwise("not_observed"))


def token_usage(events: DataFrame, *keys: str) -> DataFrame:
    """Response events (phase, error, usage_available, three token counts, returned_model, requested_model,
    returned_model_version, provider_latency_seconds) summed: attempts, usage, models and latency."""
    known = F.coalesce(F.col("usage_available"), F.lit(False))
    tokens = [F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    model = F.coalesce(F.nullif(F.col("returned_model"), F.lit("")), F.nullif(F.col("requested_model"), F.lit("")))
    return events.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("phase") == "repair").alias("repair_attempts"), F.count_if(F.coalesce(F.col("error"), F.lit(False))).alias("failed_attempts"),
        F.count_if(known).alias("usage_available_attempts"), F.count_if(~known).alias("usage_unavailable_attempts"), *tokens, names(model).alias("models"),
        names(F.nullif(F.col("returned_model_version"), F.lit(""))).alias("model_versions"), F.round(F.coalesce(F.sum("provider_latency_seconds"), F.lit(0.0)), 4).alias("provider_latency_seconds"),
    )


def response_violations(events: DataFrame) -> DataFrame:
    """(kind, attempt_id) of recorded responses (call_ordinal from 1 without gaps, attempt_id, phase) that break the rules."""
    follows = events.select((F.col("call_ordinal") + 1).alias("call_ordinal")).distinct().withColumn("follows", F.lit(True))
    seen = F.count("*").over(Window.partitionBy("call_ordinal"))
    gaps = events.withColumn("seen", seen).join(follows, "call_ordinal", "left").filter((F.col("seen") > 1) | (F.col("call_ordinal") < 1) | ((F.col("call_ordinal") > 1) & F.col("follows").isNull()))
    own = F.coalesce("attempt_id", F.lit(""))
    repeated = events.withColumn("own", own).groupBy("own").agg(F.count("*").alias("n")).filter("n > 1 or own = ''").select(F.lit("attempt").alias("kind"), F.col("own").alias("attempt_id"))
    phase = events.filter(~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), own.alias("attempt_id"))
    return pick(gaps, "ordinal").unionByName(repeated).unionByName(pick(phase, "phase"))


def case_responses(events: DataFrame) -> DataFrame:
    """Each case's slice of the recorded responses (case_id, call_ordinal, attempt_id): its first and last ordinal,
    its number of calls, and each call's place and phase, the first being the initial one."""
    w = Window.partitionBy("case_id")
    place = F.row_number().over(w.orderBy("call_ordinal"))
    return events.select(
        "case_id", "attempt_id", "call_ordinal", place.alias("place"), F.when(place == 1, "initial").otherwise("repair").alias("phase"),
        F.min("call_ordinal").over(w).alias("first"), F.max("call_ordinal").over(w).alias("last"), F.count("*").over(w).alias("calls"),
    )


def resume_violations(records: DataFrame, expected: DataFrame, identity: dict[str, str], keys: Sequence[str] = ("question_id", "variant", "run_index"), complete: bool = False) -> DataFrame:
    """(kind, key) of a checkpoint's records that don't belong to this run: another identity, a key that
    occurs twice, or one outside the schedule; with ``complete`` also scheduled keys without a record."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    other = F.lit(False)
    for name, value in identity.items():
        other = other | ~F.col(name).eqNullSafe(F.lit(value))
    strange = records.filter(other).select(F.lit("identity").alias("kind"), key.alias("key"))
    counted = records.groupBy(*keys).agg(F.count("*").alias("n"))
    twice = counted.filter("n > 1").select(F.lit("duplicate").alias("kind"), key.alias("key"))
    plan = expected.select(*keys).distinct()
    outside = counted.join(plan, list(keys), "left_anti").select(F.lit("unscheduled").alias("kind"), key.alias("key"))
    out = strange.unionByName(twice).unionByName(outside)
    if complete:
        out = out.unionByName(plan.join(counted, list(keys), "left_anti").select(F.lit("missing").alias("kind"), key.alias("key")))
    return out


def orphan_calls(deltas: DataFrame, ledger: DataFrame) -> DataFrame:
    """name, calls, recorded, orphans: calls of a ledger (name, calls) that no record's deltas (name, calls) account for.

    More recorded than made is an error: ``verdict`` says so.
    """
    said = deltas.groupBy("name").agg(F.sum("calls").alias("recorded"))
    out = ledger.join(said, "name", "left").withColumn("recorded", F.coalesce("recorded", F.lit(0)))
    left = F.col("calls") - F.col("recorded")
    return out.select("name", "calls", "recorded", left.alias("orphans"), F.when(left < 0, "over_recorded").otherwise("ok").alias("verdict"))


def run_records(cases: DataFrame, rewrites: DataFrame, retrieved: DataFrame, key: str = "question_id") -> DataFrame:
    """One record a case: its rewrite (rewrite_latency, effective_query) and retrieval (retrieval_latency, hits,
    error) joined, latencies apart and in sum; a failed or missing retrieval is a row with status error and no hits."""
    out = cases.join(rewrites, key, "left").join(retrieved.withColumn("tried", F.lit(True)), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    failed = F.col("error").isNotNull() | F.col("tried").isNull()
    return out.select(
        *cases.columns, F.coalesce("effective_query", "query").alias("effective_query"), F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(F.col("tried").isNull(), "not_run").otherwise(F.col("error")).alias("error"), F.when(failed, F.array()).otherwise(F.col("hits")).alias("hits"),
        zero("rewrite_latency").alias("rewrite_latency"), zero("retrieval_latency").alias("retrieval_latency"), (zero("rewrite_latency") + zero("retrieval_latency")).alias("latency"),
    )
