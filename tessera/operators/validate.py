"""Constraints as queries that return violations: (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violations(df: DataFrame, rule: str, key: str, bad: Column, detail: Column | None = None) -> DataFrame:
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def all_of(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def duplicates(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "key", F.col("n").cast("string").alias("detail"))


def across(df: DataFrame, rule: str, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one ``part``."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count_distinct(part).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "key", F.col("n").cast("string").alias("detail"))


def danglers(df: DataFrame, rule: str, key: str, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference has no target; null references are no violation."""
    known = targets.select(F.col(target).alias("__t")).distinct()
    lost = df.filter(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("__t"), "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(ref).cast("string").alias("detail"))


def bad_ranges(df: DataFrame, rule: str, key: str, first: str, last: str, limit: str | None = None) -> DataFrame:
    """Ranges that start below 1, end before they start or, with ``limit``, end beyond it."""
    bad = (F.col(first) < 1) | (F.col(last) < F.col(first))
    if limit:
        bad = bad | (F.col(last) > F.col(limit))
    return violations(df, rule, key, bad, F.concat_ws("-", F.col(first).cast("string"), F.col(last).cast("string")))


def one_identity(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    """A violation if the rows don't share one identity."""
    seen = df.agg(F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]).alias("n"))
    return seen.filter("n > 1").select(F.lit(rule).alias("rule"), F.lit(",".join(columns)).alias("key"), F.col("n").cast("string").alias("detail"))


# -- rules of evaluation cases (arrays of structs as in the case schema) --

KEY_SHAPE = "^[0-9a-f]{64}$"


def case_rules(cases: DataFrame) -> DataFrame:
    """Violations of the per-case rules on a table with the case columns."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    layer = lambda name: F.array_contains("evaluation_layers", name)
    node_keys = F.transform("gold_nodes", lambda n: n["stable_entity_key"])
    loose = F.exists("gold_edges", lambda e: ~F.array_contains(node_keys, e["source_key"]) | ~F.array_contains(node_keys, e["target_key"]))
    wrong_key = F.exists("gold_entities", lambda e: ~e["stable_entity_key"].rlike(KEY_SHAPE))
    unindexed = F.exists("gold_edges", lambda e: ~e["indexed_in_system"])
    verified = F.col("gold_status") == "verified"
    rules = [
        ("trace_needs_graph", (F.col("task_type") == "TRACE_CHAIN") & ((size("gold_nodes") == 0) | (size("gold_edges") == 0))),
        ("retrieval_needs_must_recall", layer("retrieval") & ~F.exists("gold_entities", lambda e: e["relevance"] == "must_recall")),
        ("entity_range", F.exists("gold_entities", lambda e: e["start_line"] > e["end_line"])),
        ("edge_ends_among_nodes", loose),
        ("reviewed_by_another", F.col("annotator") == F.col("reviewer")),
        ("rejected_not_verified", F.col("review_status").isin("rejected", "needs_review") & verified),
        ("unanswerable_needs_uncertainty", ~F.col("source_answerable") & (size("expected_uncertainties") == 0)),
        ("key_shape", wrong_key),
        ("unindexed_edge_breaks_chain", unindexed & F.col("chain_complete")),
        ("partial_needs_unindexed_edge", (F.col("system_answerable") == "partial") & ~unindexed),
        ("language", ((F.col("language") == "zh") & (F.length(F.regexp_replace("question", r"[^\x{4E00}-\x{9FFF}]", "")) < 3))),
        ("prepared_not_verified", (F.col("execution_status") == "prepared_not_executed") & verified),
    ]
    return all_of([violations(cases, name, "question_id", bad) for name, bad in rules])


def schedule_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys expected but not observed (missing) or observed but not expected (extra)."""
    a, b = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("kind", F.lit("extra")))


def snapshot_rules(cases: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Violations of gold data against a snapshot: indexed keys and edges that aren't there, unindexed items
    without a reason, must-recall items that aren't indexed, and chains that don't match their edges."""
    gold = cases.select("question_id", "system_answerable", F.explode("gold_entities").alias("e")).select("question_id", "system_answerable", "e.*")
    known = entities.select("stable_entity_key").distinct()
    lost = gold.filter("indexed_in_system").join(known, "stable_entity_key", "left_anti")
    edge = cases.select("question_id", "chain_complete", F.explode("gold_edges").alias("e")).select("question_id", "chain_complete", "e.*")
    triple = ["source_key", "target_key", "relation_type"]
    gone = edge.filter("indexed_in_system").join(relations.select(*triple).distinct(), triple, "left_anti")
    chain = edge.groupBy("question_id").agg(F.min(F.col("indexed_in_system").cast("int")).alias("all"), F.max(F.col("chain_complete").cast("int")).alias("said"))
    unexplained = ~F.col("indexed_in_system") & (F.coalesce(F.col("missing_reason"), F.lit("")) == "")
    return all_of(
        [
            violations(lost, "indexed_entity_missing", "question_id", F.lit(True), F.col("stable_entity_key")),
            violations(gone, "indexed_edge_missing", "question_id", F.lit(True), F.concat_ws(">", "source_key", "target_key")),
            violations(gold, "unindexed_without_reason", "question_id", unexplained, F.col("stable_entity_key")),
            violations(gold, "full_with_unindexed", "question_id", ~F.col("indexed_in_system") & (F.col("system_answerable") == "full"), F.col("stable_entity_key")),
            violations(gold, "must_recall_unindexed", "question_id", ~F.col("indexed_in_system") & (F.col("relevance") == "must_recall"), F.col("stable_entity_key")),
            violations(chain, "chain_disagrees", "question_id", F.col("all") != F.col("said")),
        ]
    )


def mark_membership(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """``cases`` (question_id, gold_entities) with each entity's indexed flag and missing reason set from the snapshot."""
    item = cases.select("question_id", F.posexplode("gold_entities").alias("place", "e"))
    known = entities.select(F.col("stable_entity_key").alias("k")).distinct().withColumn("there", F.lit(True))
    found = item.join(known, F.col("e.stable_entity_key") == F.col("k"), "left").withColumn("there", F.coalesce("there", F.lit(False)))
    reason = F.when(F.col("there"), None).otherwise(F.coalesce(F.col("e.missing_reason"), F.lit("not_in_snapshot")))
    fixed = found.withColumn("e", F.col("e").withField("indexed_in_system", F.col("there")).withField("missing_reason", reason))
    listed = fixed.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "e"))), lambda x: x["e"]).alias("fixed"))
    return cases.join(listed, "question_id", "left").withColumn("gold_entities", F.coalesce("fixed", "gold_entities")).drop("fixed")


def recompute_answerability(cases: DataFrame) -> DataFrame:
    """``cases`` (task_type, gold_entities, gold_nodes, gold_edges, chain_complete, system_answerable) with the last two
    following from which gold items are indexed, and ``changes``, the names of the columns that changed."""
    listed = lambda c: F.coalesce(F.col(c), F.array())
    entities, nodes, edges = listed("gold_entities"), listed("gold_nodes"), listed("gold_edges")
    there = lambda x: F.coalesce(x["indexed_in_system"], F.lit(False))
    gone = lambda x: F.coalesce(~x["indexed_in_system"], F.lit(False))
    every, any_ = (lambda a: F.forall(a, there)), (lambda a: F.exists(a, there))
    lost = lambda a: F.exists(a, gone)
    must = F.filter(entities, lambda x: x["relevance"] == "must_recall")
    useful = F.filter(entities, lambda x: x["relevance"].isin("must_recall", "acceptable_alternative"))
    trace, linked, whole = F.col("task_type") == "TRACE_CHAIN", F.size(edges) > 0, every(edges) & every(nodes)
    complete = F.when(trace & linked, whole).when(trace & F.col("chain_complete").isNotNull(), F.lit(False)).otherwise(F.col("chain_complete"))
    with_edges = F.when(whole & every(must), "full").when(lost(nodes) | lost(edges), F.when(any_(nodes) | any_(edges) | any_(must), "partial").otherwise("insufficient")).otherwise("full")
    seen, missing = any_(entities) | any_(nodes), lost(entities) | lost(nodes)
    without = F.when(seen & (missing | (F.size(nodes) > 0)), "partial").otherwise("insufficient")
    asked = F.when((F.size(useful) > 0) & every(useful), "full").when(any_(useful), "partial").otherwise("insufficient")
    answerable = (
        F.when(trace, F.when(linked, with_edges).otherwise(without)).when(F.size(entities) == 0, F.col("system_answerable"))
        .when(F.col("task_type") == "CODE_QA", asked).when(F.col("task_type") == "CHANGE_PLAN", F.when(every(must), "full").otherwise("partial")).otherwise(F.col("system_answerable"))
    )
    out = cases.withColumn("new_chain", complete).withColumn("new_answer", answerable)
    changed = F.filter(F.array(F.when(~F.col("new_chain").eqNullSafe(F.col("chain_complete")), "chain_complete"), F.when(~F.col("new_answer").eqNullSafe(F.col("system_answerable")), "system_answerable")), lambda x: x.isNotNull())
    return out.withColumn("changes", changed).withColumn("chain_complete", F.col("new_chain")).withColumn("system_answerable", F.col("new_answer")).drop("new_chain", "new_answer")


# States of a manifest's repositories, those that have a clone, and addresses of a folder inside one.
STATES = ("candidate", "selected", "cloned", "indexed")
CLONED = ("cloned", "indexed")
FOLDER_URL = r"/(?:tree|blob)/[^/]+/.+"
SAMPLE = "sample-project"
MANIFEST = "repo_id string, clone_url string, commit_sha string, status string, verified boolean, file_counts_verified boolean, license string, license_note string, repository_subdir string, parent_repo string"


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """A parsed manifest's repositories as rows; ``repository_subdir`` is the value's JSON, as its kind matters."""
    import json

    if not isinstance(repos := manifest.get("repositories", []), list):
        raise ValueError("repositories must be a list")
    text = lambda x: None if x is None else str(x)
    flag = lambda x: x is True

    def row(r: dict) -> tuple:
        subdir = r.get("repository_subdir")
        return (
            text(r.get("repo_id")), text(r.get("clone_url")), text(r.get("commit_sha")), text(r.get("status")), flag(r.get("verified")), flag(r.get("file_counts_verified")),
            text(r.get("license")), text(r.get("license_note")), None if subdir is None else json.dumps(subdir), text(r.get("parent_repo")),
        )

    return spark.createDataFrame([row(r) for r in repos], MANIFEST)


def manifest_rules(repos: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Violations of the rules of repositories (columns of ``MANIFEST``), all tested in one pass.

    A repository without an address is a fixture, which needs no licence.  With ``workspaces`` (repo_id: the folders that are
    there) a cloned repository needs one.
    """
    c = F.col
    cloned, fixture = c("status").isin(*CLONED), c("clone_url").isNull()
    no = lambda name: F.coalesce(c(name), F.lit("")) == ""
    tests = {
        "clone_url_is_a_folder": c("clone_url").rlike(FOLDER_URL),
        "commit_sha_form": c("commit_sha").isNotNull() & ~c("commit_sha").rlike("^[0-9a-f]{40}$"),
        "status_unknown": ~F.coalesce(c("status").isin(*STATES), F.lit(False)),
        "cloned_without_commit": cloned & c("commit_sha").isNull(),
        "verified_without_counts": c("verified") & ~F.coalesce(c("file_counts_verified"), F.lit(False)),
        "license_missing": ~fixture & c("license").isNull(),
        "gpl_without_note": F.contains(F.lower("license"), F.lit("gpl")) & no("license_note"),
        "subdir_is_no_string": c("repository_subdir").isNotNull() & ~F.startswith(c("repository_subdir"), F.lit('"')),
        "sample_without_parent": (c("repo_id") == SAMPLE) & no("parent_repo"),
        "repo_id_missing": c("repo_id").isNull(),
    }
    known = repos
    if workspaces is not None:
        known = repos.join(workspaces.select("repo_id", F.lit(True).alias("there")).distinct(), "repo_id", "left")
        tests["workspace_missing"] = cloned & c("there").isNull()
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()]), lambda x: x.isNotNull())
    each = known.select(F.explode(broken).alias("rule"), F.coalesce(c("repo_id"), F.lit("<unknown>")).alias("key"), F.lit("").alias("detail"))
    return each.unionByName(duplicates(repos.filter(c("repo_id").isNotNull()), "repo_id_repeated", "repo_id"))
