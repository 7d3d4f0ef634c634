"""Registered queries of evaluation runs, reports, parsing and relations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testdata as td
from tessera.functions import scalars
from tessera.operators import context, evaluation, graph, json_schema, metrics, parsing, relations, stats, validate
from tessera.queries import query
from tessera.sources import files, places
from tessera.sources.store import snapshot

# -- gold and predictions --

_HIT = {k: f"avg(CASE WHEN len(gold) > 0 THEN coalesce(({td.FIRST} <= {k})::INT, 0) END)" for k in evaluation.CUTOFFS}
_JOINED = f"""{td.RANK}, g AS (SELECT question_id, gold, question_id % 5 <> 0 AS answerable FROM rank WHERE variant = 'W70'),
p AS (SELECT question_id, predicted FROM rank WHERE variant = 'W70' AND question_id % 3 <> 0),
j AS (SELECT g.*, coalesce(predicted, []) AS predicted, p.question_id IS NULL AS lost FROM g LEFT JOIN p USING (question_id)),
s AS (SELECT *, unnest(['overall', CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END]) AS split FROM j)"""


@query(
    f"WITH {_JOINED} SELECT split, count(*) AS n, " + ", ".join(f"round({x}, 6)::DOUBLE AS r{k}" for k, x in _HIT.items())
    + f", round(avg(CASE WHEN len(gold) > 0 THEN coalesce(1.0::DOUBLE / {td.FIRST}, 0) END), 6) AS mrr, sum(lost::INT)::BIGINT AS unmatched, round(avg((len(predicted) > 0)::INT), 6)::DOUBLE AS nonempty_rate FROM s GROUP BY split"
)
def metric_gold_join(spark, sf):
    rows = td.rankings(spark, sf).filter("variant = 'W70'")
    gold = rows.select("question_id", "gold", (F.col("question_id") % 5 != 0).alias("answerable"))
    out = evaluation.splits(evaluation.gold_join(gold, rows.filter("question_id % 3 <> 0").select("question_id", "predicted")))
    return out.select("split", "n", *[F.round(c, 6).alias(c) for c in ("r1", "r5", "r10", "mrr")], "unmatched", F.round("nonempty_rate", 6).alias("nonempty_rate"))


@query(
    f"WITH {td.RANK}, r AS (SELECT variant, question_id % 7 <> 0 AS answerable, CASE WHEN question_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN question_id % 11 = 0 OR question_id % 4 = 0 THEN 0 ELSE len(predicted) END AS k FROM rank) "
    "SELECT variant, count(*) FILTER (status <> 'ok') AS failures, count(*) FILTER (NOT answerable) AS n, round(avg((k > 0)::INT) FILTER (NOT answerable), 4)::DOUBLE AS nonempty_hit_rate, round(avg((status <> 'ok')::INT) FILTER (NOT answerable), 4)::DOUBLE AS error_rate FROM r GROUP BY variant"
)
def metric_unanswerable(spark, sf):
    q = F.col("question_id")
    rows = td.rankings(spark, sf).select("variant", (q % 7 != 0).alias("answerable"), F.when(q % 11 == 0, "error").otherwise("ok").alias("status"), F.when((q % 11 != 0) & (q % 4 != 0), F.col("predicted")).otherwise(F.array().cast("array<bigint>")).alias("predicted"))
    return evaluation.unanswerable_diagnostics(rows)


@query(
    f"WITH {td.RANK}, r AS (SELECT variant, predicted[1:8] AS n, gold AS gn, predicted[1:4] AS e, gold[1:2] AS ge FROM rank), "
    "c AS (SELECT *, len(list_filter(gn, lambda x: NOT list_contains(n, x))) = 0 AND len(list_filter(ge, lambda x: NOT list_contains(e, x))) = 0 AS whole, len(list_intersect(n, gn)) AS nh, len(list_intersect(e, ge)) AS eh FROM r) "
    "SELECT variant, count(*) AS n, round(avg(whole::INT), 6)::DOUBLE AS complete_chain_rate, round(sum(nh) / sum(len(n)), 6)::DOUBLE AS node_precision, round(sum(nh) / sum(len(gn)), 6)::DOUBLE AS node_recall, round(sum(eh) / sum(len(e)), 6)::DOUBLE AS edge_precision, round(sum(eh) / sum(len(ge)), 6)::DOUBLE AS edge_recall, round(1 - sum(eh) / sum(len(e)), 6)::DOUBLE AS non_gold_edge_rate FROM c GROUP BY variant"
)
def metric_graph_chain(spark, sf):
    cut = lambda c, k: F.slice(c, 1, k)
    rows = td.rankings(spark, sf).select("variant", cut("predicted", 8).alias("nodes"), F.col("gold").alias("gold_nodes"), cut("predicted", 4).alias("edges"), cut("gold", 2).alias("gold_edges"))
    out = evaluation.graph_measures(rows)
    return out.select("variant", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("variant", "n")])


@query(
    f"WITH {td.RANK}, r AS (SELECT variant, predicted[1:6] AS p, gold AS g, predicted[3:4] AS w FROM rank) "
    "SELECT variant, count(*) AS n, round(sum(len(list_intersect(p, g))) / sum(len(p)), 4)::DOUBLE AS positive_precision, round(sum(len(list_intersect(p, g))) / sum(len(g)), 4)::DOUBLE AS positive_recall, round(sum(len(list_intersect(p, w))) / sum(len(p)), 4)::DOUBLE AS violation_rate FROM r GROUP BY variant"
)
def metric_change_plan(spark, sf):
    rows = td.rankings(spark, sf).select("variant", F.slice("predicted", 1, 6).alias("predicted"), F.col("gold").alias("positive"), F.slice("predicted", 3, 2).alias("negative"))
    return evaluation.change_plan_files(rows, "variant")


@query(
    "WITH g AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'entity' ELSE 'nodes' END AS component, o_orderkey AS key, max(o_custkey) AS q FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 20 = 0 GROUP BY ALL), "
    "s AS (SELECT DISTINCT l_returnflag AS variant, 'entity' AS component, l_orderkey AS key FROM lineitem WHERE l_linenumber = 4), c AS (SELECT component, count(*) AS gold_count FROM g GROUP BY component), "
    "o AS (SELECT component, variant, count(*) AS n, count(DISTINCT q) AS m FROM s JOIN g USING (component, key) GROUP BY ALL) "
    "SELECT component, variant, gold_count, coalesce(n, 0) AS observed_count, coalesce(m, 0) AS questions, CASE WHEN n > 0 THEN 'observed' ELSE 'not_observed' END AS status FROM (SELECT * FROM c, (SELECT unnest(['A', 'N', 'R', 'Z']) AS variant)) LEFT JOIN o USING (component, variant)"
)
def source_only_diagnostics(spark, sf):
    o = td.table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'")
    gold = o.select(F.when(F.col("o_orderstatus") == "F", "entity").otherwise("nodes").alias("component"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("question_id"), (F.col("o_orderkey") % 20 != 0).alias("indexed"))
    seen = td.table(spark, sf, "lineitem").filter("l_linenumber = 4").select(F.col("l_returnflag").alias("variant"), F.lit("entity").alias("component"), F.col("l_orderkey").alias("key"))
    return evaluation.source_only(gold, seen, ["A", "N", "R", "Z"])


_CASE = "SELECT o_orderkey AS question_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'machine_verified' WHEN '2-HIGH' THEN 'human_verified' ELSE 'draft' END AS gs, CASE WHEN o_custkey % 4 = 0 THEN 'pending' ELSE 'accepted' END AS rs, CASE o_orderstatus WHEN 'P' THEN 'blocked' ELSE 'executed' END AS es, o_orderkey % 3 AS l FROM orders"


@query(
    f"WITH c AS ({_CASE}) SELECT coalesce(CASE WHEN gs NOT IN ('machine_verified', 'human_verified') THEN 'gold_status=' || gs WHEN rs <> 'accepted' THEN 'review_status=' || rs WHEN es NOT IN ('executable', 'executed') THEN 'execution_status=' || es WHEN l = 0 THEN 'no_retrieval_layer' END, 'eligible') AS reason, count(*) AS n FROM c GROUP BY 1"
)
def case_eligibility(spark, sf):
    o = td.table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "machine_verified").when(F.col("o_orderpriority") == "2-HIGH", "human_verified").otherwise("draft").alias("gold_status"),
        F.when(F.col("o_custkey") % 4 == 0, "pending").otherwise("accepted").alias("review_status"), F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("executed").alias("execution_status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("graph"))).otherwise(F.array(F.lit("retrieval"), F.lit("graph"))).alias("evaluation_layers"),
    )
    return o.groupBy(F.coalesce(evaluation.exclusion_reason(), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


# -- runs and ledgers --

_EVENT = "SELECT event_id, user_id, event_type, value, (props->>'k')::INT AS k FROM events"


def _responses(spark, sf):
    e = td.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", "user_id", F.when(F.col("event_type") == "click", "repair").otherwise("initial").alias("phase"), (F.col("event_type") == "error").alias("error"), (k % 2 == 0).alias("usage_available"),
        k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), (k * 3).alias("total_tokens"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("event_type")).alias("returned_model"), F.lit("asked").alias("requested_model"),
        F.when(k % 5 == 0, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("returned_model_version"), F.floor(F.col("value")).alias("provider_latency_seconds"),
    )


@query(
    f"WITH e AS ({_EVENT}) SELECT user_id % 50 AS part, count(*) AS attempts, count(*) FILTER (event_type = 'click') AS repair_attempts, count(*) FILTER (event_type = 'error') AS failed_attempts, count(*) FILTER (k % 2 = 0) AS usage_available_attempts, count(*) FILTER (k % 2 <> 0) AS usage_unavailable_attempts, "
    "coalesce(sum(k) FILTER (k % 2 = 0), 0)::BIGINT AS prompt_tokens, coalesce(sum(2 * k) FILTER (k % 2 = 0), 0)::BIGINT AS completion_tokens, coalesce(sum(3 * k) FILTER (k % 2 = 0), 0)::BIGINT AS total_tokens, "
    "string_agg(DISTINCT CASE WHEN k % 3 = 0 THEN 'asked' ELSE event_type END, ',' ORDER BY CASE WHEN k % 3 = 0 THEN 'asked' ELSE event_type END) AS models, coalesce(string_agg(DISTINCT 'v' || (k % 4), ',' ORDER BY 'v' || (k % 4)) FILTER (k % 5 = 0), '') AS model_versions, round(sum(floor(value)), 4)::DOUBLE AS provider_latency_seconds FROM e GROUP BY 1"
)
def token_usage(spark, sf):
    rows = _responses(spark, sf).withColumn("part", F.col("user_id") % 50).withColumn("provider_latency_seconds", F.col("provider_latency_seconds").cast("double"))
    return evaluation.token_usage(rows, "part")


@query(f"WITH e AS ({_EVENT}), r AS (SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, min(event_id) OVER w AS first, max(event_id) OVER w AS last, count(*) OVER w AS calls FROM e WINDOW w AS (PARTITION BY user_id)) SELECT case_id, event_id AS call_ordinal, place::INT AS place, CASE WHEN place = 1 THEN 'initial' ELSE 'repair' END AS phase, first, last, calls FROM r")
def response_slices(spark, sf):
    rows = _responses(spark, sf).select(F.col("user_id").alias("case_id"), F.col("event_id").cast("string").alias("attempt_id"), F.col("event_id").alias("call_ordinal"))
    return evaluation.case_responses(rows).drop("attempt_id")


@query(
    f"WITH e AS ({_EVENT}), r AS (SELECT event_id - (SELECT min(event_id) FROM e) + 1 AS o, CASE WHEN k = 7 THEN '' WHEN event_id % 100 = 1 THEN 'same' ELSE event_id::VARCHAR END AS a, CASE WHEN k = 9 THEN 'late' ELSE 'initial' END AS phase FROM e WHERE event_id % 37 <> 5), "
    "x AS (SELECT 'ordinal' AS kind, a FROM r WHERE o > 1 AND o - 1 NOT IN (SELECT o FROM r) UNION ALL SELECT 'attempt', a FROM r GROUP BY a HAVING count(*) > 1 OR a = '' UNION ALL SELECT 'phase', a FROM r WHERE phase = 'late') SELECT kind, a AS attempt_id FROM x"
)
def response_rules(spark, sf):
    e = td.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    first = e.agg(F.min("event_id").alias("least"))
    rows = e.filter("event_id % 37 <> 5").crossJoin(F.broadcast(first)).select(
        (F.col("event_id") - F.col("least") + 1).alias("call_ordinal"), F.when(F.col("k") == 7, "").when(F.col("event_id") % 100 == 1, "same").otherwise(F.col("event_id").cast("string")).alias("attempt_id"),
        F.when(F.col("k") == 9, "late").otherwise("initial").alias("phase"),
    )
    return evaluation.response_violations(rows)


@query(
    "WITH r AS (SELECT o_custkey AS q, o_orderstatus AS v, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 10 = 0 THEN 'old' ELSE 'run' END AS run_id FROM orders), c AS (SELECT q, v, count(*) AS n FROM r GROUP BY ALL), e AS (SELECT c_custkey AS q, v FROM customer, (SELECT unnest(['F', 'O']) AS v) WHERE c_custkey % 9 <> 4) "
    "SELECT kind, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'identity' AS kind, q || '|' || v AS key FROM r WHERE run_id <> 'run' UNION ALL SELECT 'duplicate', q || '|' || v FROM c WHERE n > 1 UNION ALL SELECT 'unscheduled', q || '|' || v FROM c ANTI JOIN e USING (q, v) UNION ALL SELECT 'missing', q || '|' || v FROM e ANTI JOIN c USING (q, v)) GROUP BY kind"
)
def resume_rules(spark, sf):
    o = td.table(spark, sf, "orders")
    old = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 10 == 0)
    records = o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("variant"), F.when(old, "old").otherwise("run").alias("run_id"))
    plan = td.table(spark, sf, "customer").filter("c_custkey % 9 <> 4").select(F.col("c_custkey").alias("question_id"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("variant"))
    out = evaluation.resume_violations(records, plan, {"run_id": "run"}, ("question_id", "variant"), complete=True)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(
    "WITH l AS (SELECT event_type AS name, count(*) + CASE WHEN event_type = 'view' THEN -5 ELSE 3 END AS calls FROM events GROUP BY event_type), d AS (SELECT event_type AS name, count(*) AS recorded FROM events WHERE event_type <> 'signup' GROUP BY 1) "
    "SELECT name, calls, coalesce(recorded, 0) AS recorded, calls - coalesce(recorded, 0) AS orphans, CASE WHEN calls < coalesce(recorded, 0) THEN 'over_recorded' ELSE 'ok' END AS verdict FROM l LEFT JOIN d USING (name)"
)
def orphan_calls(spark, sf):
    e = td.table(spark, sf, "events")
    ledger = e.groupBy(F.col("event_type").alias("name")).agg((F.count("*") + F.when(F.first("event_type") == "view", -5).otherwise(3)).alias("calls"))
    deltas = e.filter("event_type <> 'signup'").groupBy(F.col("event_type").alias("name"), "user_id").agg(F.count("*").alias("calls")).drop("user_id")
    return evaluation.orphan_calls(deltas, ledger)


@query(
    "WITH c AS (SELECT event_id AS question_id, 'q' || event_id AS query, event_type, round(value, 3) AS v FROM events) SELECT question_id, query, CASE WHEN event_type = 'click' THEN 'Q' || question_id ELSE query END AS effective_query, CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'ok' END AS status, "
    "CASE event_type WHEN 'error' THEN 'boom' WHEN 'signup' THEN 'not_run' END AS error, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 2 END::INT AS n_hits, CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END::DOUBLE AS rewrite_latency, CASE WHEN event_type = 'signup' THEN 0 ELSE v END::DOUBLE AS retrieval_latency, round(CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END + CASE WHEN event_type = 'signup' THEN 0 ELSE v END, 6)::DOUBLE AS latency FROM c"
)
def run_records(spark, sf):
    e = td.table(spark, sf, "events").withColumnRenamed("event_id", "question_id")
    cases = e.select("question_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("query"))
    rewrites = e.filter("event_type = 'click'").select("question_id", F.lit(0.5).alias("rewrite_latency"), F.concat(F.lit("Q"), F.col("question_id").cast("string")).alias("effective_query"))
    found = e.filter("event_type <> 'signup'").select("question_id", F.round("value", 3).alias("retrieval_latency"), F.array("question_id", "user_id").alias("hits"), F.when(F.col("event_type") == "error", "boom").alias("error"))
    out = evaluation.run_records(cases, rewrites, found)
    return out.withColumn("n_hits", F.size("hits")).drop("hits").withColumn("latency", F.round("latency", 6))


# -- tables of counts --


@query("WITH c AS (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang) SELECT lang, n, n_chars, row_number() OVER (ORDER BY n DESC, lang)::INT AS place FROM c UNION ALL SELECT '*', sum(n)::BIGINT, sum(n_chars)::BIGINT, 0 FROM c")
def language_table(spark, sf):
    return stats.ranked_counts(td.table(spark, sf, "documents"), "lang", "n_chars")


@query(f"WITH {td.GRAPH} SELECT count(*) AS relations, count(DISTINCT target_id) AS calls FROM edges WHERE relation_type = 'REQUESTS_API'")
def matched_relations(spark, sf):
    return stats.matched_relations(td.edges(spark, sf).select("relation_type", F.col("target_id").alias("source_id")))


@query(
    f"WITH {td.GRAPH} SELECT (SELECT count(*) FROM documents) AS files_indexed, (SELECT count(*) FROM nodes) AS entities_indexed, (SELECT count(*) FROM edges) AS relations_indexed, (SELECT count(*) FROM pages WHERE page_id % 4 = 1) AS files_skipped, (SELECT count(*) FROM pages WHERE page_id % 4 = 2) AS parse_errors"
)
def scan_summary(spark, sf):
    issues = td.table(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 1, "skipped").when(F.col("page_id") % 4 == 2, "parse_error").otherwise("analysis_warning").alias("issue_type"))
    return stats.scan_summary(td.table(spark, sf, "documents"), td.nodes(spark, sf), td.edges(spark, sf), issues)


def _named_sql(table: str, key: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1))"


@query(f"WITH {td.GRAPH} SELECT count(*) AS files, sum(n_chars)::BIGINT AS lines, {_named_sql('documents', 'lang')} AS languages, {_named_sql('nodes', chr(39) + 'node' + chr(39))} AS entity_types, {_named_sql('edges', 'relation_type')} AS relation_types, {_named_sql('pages', 'CASE WHEN page_id % 3 = 0 THEN ' + chr(39) + 'skipped' + chr(39) + ' ELSE ' + chr(39) + 'parse_error' + chr(39) + ' END')} AS issue_types FROM documents")
def project_stats(spark, sf):
    files = td.table(spark, sf, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("line_count"))
    issues = td.table(spark, sf, "pages").select(F.when(F.col("page_id") % 3 == 0, "skipped").otherwise("parse_error").alias("issue_type"))
    out = stats.project_stats(files, td.nodes(spark, sf).select(F.lit("node").alias("entity_type")), td.edges(spark, sf), issues)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return out.select("files", "lines", *[text(c) for c in ("languages", "entity_types", "relation_types", "issue_types")])


def _invocations(spark, sf):
    n = F.col("c_nationkey").cast("string")
    m = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target_key"), F.concat(F.lit("pkg.N"), F.col("s_nationkey").cast("string")).alias("class_name"), F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")).alias("method"))
    receiver = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("N"), n)).when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("pkg.N"), n))
    inv = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("invocation_id"), F.col("c_custkey").alias("source_key"), receiver.alias("receiver_type"), F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string")).alias("method"))
    return inv, m, m.select("class_name").distinct().filter("class_name <> 'pkg.N3'")


_INV = """m AS (SELECT s_suppkey AS target_key, 'pkg.N' || s_nationkey AS class_name, 'm' || (s_suppkey % 40) AS method FROM supplier), svc AS (SELECT DISTINCT class_name, unnest([class_name, split_part(class_name, '.', 2)]) AS receiver_type FROM m WHERE class_name <> 'pkg.N3'),
inv AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'N' || c_nationkey ELSE 'pkg.N' || c_nationkey END AS receiver_type, 'm' || (c_custkey % 40) AS method FROM customer)"""


@query(f"WITH {_INV} SELECT receiver_type, count(*) AS n, receiver_type IN (SELECT receiver_type FROM svc) AS known FROM inv WHERE receiver_type IS NOT NULL GROUP BY receiver_type")
def receiver_type_table(spark, sf):
    inv, _, services = _invocations(spark, sf)
    return relations.receiver_types(inv, services)


@query(
    f"WITH {_INV}, ms AS (SELECT * FROM m WHERE class_name IN (SELECT class_name FROM svc)), t AS (SELECT receiver_type, method FROM svc JOIN ms USING (class_name) GROUP BY ALL HAVING count(*) = 1), u AS (SELECT method FROM ms GROUP BY method HAVING count(*) = 1) "
    "SELECT CASE WHEN receiver_type IS NULL AND method IN (SELECT method FROM u) OR (receiver_type, method) IN (SELECT (receiver_type, method) FROM t) THEN 'resolved' WHEN receiver_type IS NOT NULL AND receiver_type NOT IN (SELECT receiver_type FROM svc) THEN 'receiver_not_a_service' ELSE 'method_not_unique_or_missing' END AS reason, count(*) AS n FROM inv GROUP BY 1"
)
def resolution_funnel(spark, sf):
    return relations.resolution_funnel(*_invocations(spark, sf))


@query(f"WITH {td.GRAPH}, e AS (SELECT * FROM edges WHERE relation_type <> 'REQUESTS_API'), n AS (SELECT source_id AS entity_id FROM e UNION SELECT target_id FROM e) SELECT 'node' AS kind, count(*) AS n, min(entity_id) AS least, max(entity_id) AS most FROM n UNION ALL SELECT 'edge', count(*), min(relation_id), max(relation_id) FROM e")
def graph_eval_merge(spark, sf):
    edges = td.edges(spark, sf).filter("relation_type <> 'REQUESTS_API'")
    twice = edges.unionByName(edges)
    nodes, own = graph.merge_by_id(twice.select(F.col("source_id").alias("entity_id")).unionByName(twice.select(F.col("target_id").alias("entity_id"))), twice)
    one = lambda df, c, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min(c).alias("least"), F.max(c).alias("most"))
    return one(nodes, "entity_id", "node").unionByName(one(own, "relation_id", "edge"))


@query(
    f"WITH {td.GRAPH}, w AS (SELECT s AS place, s AS entity_id, 0 AS depth FROM (SELECT unnest([{td.NATION}, {td.NATION + 1}]) AS s) UNION ALL SELECT DISTINCT here, other, 1 FROM around WHERE here IN ({td.NATION}, {td.NATION + 1}) AND relation_type = 'CALLS_METHOD'), "
    "f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY place, depth) = 1) SELECT (row_number() OVER (ORDER BY place, depth, entity_id))::INT AS citation, entity_id, qualified_name FROM f JOIN nodes USING (entity_id)"
)
def graph_references(spark, sf):
    seeds = spark.createDataFrame([(td.NATION, td.NATION), (td.NATION + 1, td.NATION + 1)], "seed_id long, place long")
    nodes, _ = graph.merge(graph.traverse(td.nodes(spark, sf), td.edges(spark, sf), seeds, 1, ["CALLS_METHOD"]), seeds)
    return graph.references(nodes, td.nodes(spark, sf)).select("citation", "entity_id", "qualified_name")


# -- lists and texts --


@query(
    "WITH s AS (SELECT user_id % 7 AS project_id, event_type || (user_id % 13) AS query, max(ts) AS seen FROM events WHERE user_id % 7 > 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY seen DESC, project_id, query) AS place FROM s QUALIFY place <= 20) "
    "SELECT project_id, query, place::INT AS place, (row_number() OVER (ORDER BY CASE WHEN project_id = 3 THEN 0 ELSE 1 END, place))::INT AS shown FROM k QUALIFY shown <= 8"
)
def visible_history(spark, sf):
    e = td.table(spark, sf, "events")
    text = F.concat(F.lit(" "), F.col("event_type"), (F.col("user_id") % 13).cast("string"))
    rows = e.select((F.col("user_id") % 7).alias("project_id"), text.alias("query"), F.col("ts").alias("searched_at"))
    return context.visible_history(context.search_history(rows), 3).drop("searched_at")


def _page_sql(order: str) -> str:
    return f"SELECT * FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name || ' /src/' || s_nationkey), '/src/1') ORDER BY {order} LIMIT 5 OFFSET 5)"


@query(f"SELECT 'id' AS sort, * FROM ({_page_sql('id')}) UNION ALL SELECT 'name', * FROM ({_page_sql('name, id')}) UNION ALL SELECT 'scan', * FROM ({_page_sql('s_acctbal DESC, s_suppkey % 10, id')}) UNION ALL SELECT 'manual', * FROM ({_page_sql('s_suppkey % 10, id')})")
def project_pages(spark, sf):
    s = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/src/"), F.col("s_nationkey").cast("string")).alias("root_path"), (F.col("s_suppkey") % 10).alias("sort_order"), F.col("s_acctbal").alias("last_scan_at"))
    out = None
    for sort in ("id", "name", "scan", "manual"):
        one = context.project_page(s, " /SRC/1", sort, 2, 5).select(F.lit(sort).alias("sort"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 3 = 1 THEN props ELSE '{}' END AS metadata FROM events")
def json_object_guard(spark, sf):
    e = td.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 6 == 0, "[1, 2]").when(F.col("event_id") % 6 == 3, "{broken").when(F.col("event_id") % 3 == 1, F.col("props"))
    return e.select("event_id", scalars.json_object(text).alias("metadata"))


@query(
    "SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Indexed relationship limits:' || chr(10) || '- No stored REQUESTS_API edge was found; its relationship cannot be determined from indexed code.' ELSE '' END AS answer FROM conversations WHERE text IS NOT NULL"
)
def relationship_limits(spark, sf):
    c = td.table(spark, sf, "conversations").filter("text is not null")
    told = F.lit("No stored REQUESTS_API edge was found; its relationship cannot be determined from indexed code.")
    notes = F.when(F.col("turn") % 2 == 0, F.array(F.lit("The answer is short."), told)).otherwise(F.array(F.lit("No stored edge.")))
    return c.select("conv_id", "turn", scalars.with_limits(F.col("text"), notes).alias("answer"))


# -- source code: a generated tree, one folder a nation --


def _tree(spark, sf):
    """Three files a nation: a service with its controller, a page that calls it, and a Python module."""
    k = F.col("n_nationkey").cast("string")
    java = F.concat(
        F.lit("@Service\npublic class S"), k, F.lit(" {\n    public String run"), k, F.lit("(int x) { return null; }\n}\n"),
        F.lit("@RestController\n@RequestMapping(\"/api/n"), k, F.lit("\")\nclass C"), k, F.lit(" {\n    @Autowired\n    private S"), k, F.lit(" svc;\n    @GetMapping(\"/{id}\")\n    public String find"), k,
        F.lit("(int id) { return svc.run"), k, F.lit("(id); }\n}\n"),
    )
    page = F.concat(F.lit("axios.get('/api/n"), k, F.lit("/7?x=1')\nfetch(somewhere)\n"))
    module = F.concat(F.lit("class P"), k, F.lit(":\n    def go(self):\n        return 1\n\nasync def main"), k, F.lit("():\n    pass\n"))
    row = lambda name, language, text: F.struct(F.concat(F.lit("n"), k, F.lit(f"/{name}")).alias("file_path"), F.lit(language).alias("language"), text.alias("content"))
    broken = F.when(F.col("n_nationkey") % 5 == 0, F.lit("def broken(:\n")).otherwise(module)
    files = F.explode(F.array(row("A.java", "java", java), row("view.js", "javascript", page), row("mod.py", "python", broken)))
    return td.table(spark, sf, "nation").select(files.alias("f")).select("f.*")


def _indexed(spark, sf):
    parsed = places.settled(parsing.parse_files(_tree(spark, sf)), "parsed")
    calls, warnings = parsing.resolve_requests(parsed.select(F.inline("requests")), *parsing.catalogs(parsed))
    entities = relations.last_of_each(parsed.select(F.inline("entities")).unionByName(calls).withColumn("ordinal", F.col("start_line"))).drop("ordinal")
    issues = warnings.unionByName(parsing.parse_errors(parsed))
    return parsed, entities, issues


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_nationkey % 5 = 0 AS bad FROM nation) SELECT * FROM (SELECT 'n' || k || '/A.java' AS file_path, unnest(['java_class', 'java_method', 'java_class', 'java_method', 'backend_api']) AS entity_type, unnest(['S' || k, 'run' || k, 'C' || k, 'find' || k, 'GET /api/n' || k || '/{id}']) AS name, unnest([1, 3, 5, 10, 10]) AS line FROM n "
    "UNION ALL SELECT 'n' || k || '/view.js', 'frontend_api_call', 'GET /api/n' || k || '/7?x=1', 1 FROM n UNION ALL SELECT 'n' || k || '/mod.py', unnest(['python_class', 'python_function', 'python_function']), unnest(['P' || k, 'go', 'main' || k]), unnest([1, 2, 5]) FROM n WHERE NOT bad)"
)
def parse_entities(spark, sf):
    return _indexed(spark, sf)[1].select("file_path", "entity_type", "name", F.col("start_line").alias("line"))


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_nationkey % 5 = 0 AS bad FROM nation) SELECT 'n' || k || '/view.js' AS file_path, 'analysis_warning' AS issue_type, 'FRONTEND_REQUEST_DYNAMIC_URL' AS reason_code FROM n UNION ALL SELECT 'n' || k || '/mod.py', 'parse_error', 'PARSE_ERROR' FROM n WHERE bad"
)
def parse_issues(spark, sf):
    return _indexed(spark, sf)[2].select("file_path", "issue_type", "reason_code")


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_nationkey % 5 = 0 AS bad FROM nation) SELECT relation_type, source, target, confidence::DOUBLE AS confidence FROM (SELECT unnest(['CONTAINS', 'CONTAINS', 'DEFINES_API', 'CALLS_METHOD', 'REQUESTS_API']) AS relation_type, unnest(['S' || k, 'C' || k, 'GET /api/n' || k || '/{id}', 'find' || k, 'GET /api/n' || k || '/7?x=1']) AS source, unnest(['run' || k, 'find' || k, 'find' || k, 'run' || k, 'GET /api/n' || k || '/{id}']) AS target, unnest([1.0, 1.0, 1.0, 0.8, 1.0]) AS confidence FROM n "
    "UNION ALL SELECT 'CONTAINS', 'P' || k, 'go', 1.0 FROM n WHERE NOT bad)"
)
def derive_relations(spark, sf):
    parsed, entities, _ = _indexed(spark, sf)
    keyed = entities.withColumn("id", F.xxhash64("local_key"))
    edges = relations.resolve_ends(relations.derive(entities, parsed.select(F.inline("relations"))), keyed)
    for side in ("source", "target"):
        edges = edges.join(keyed.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side)), f"{side}_id")
    return edges.select("relation_type", "source", "target", "confidence")


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k FROM nation) SELECT sha256('repo|c0ffee|n' || k || '/view.js|frontend_api_call|GET /api/n' || k || '/7?x=1|1|1') AS stable_entity_key, 'n' || k || '/view.js' AS file_path FROM n"
)
def snapshot_keys(spark, sf):
    _, entities, issues = _indexed(spark, sf)
    files = _tree(spark, sf).withColumn("line_count", scalars.line_count(F.col("content")))
    none = spark.createDataFrame([], "source_id long, target_id long, relation_type string, confidence double")
    out = snapshot(files, entities.withColumn("id", F.xxhash64("local_key")), none, issues, "repo", "c0ffee")
    return out["code_entities"].filter("entity_type = 'frontend_api_call'").select("stable_entity_key", "file_path")


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey::VARCHAR AS id, ['t' || c_mktsegment, 'l' || (c_nationkey % 5), 'a' || (c_acctbal > 0)] AS marks,
  {'hard': CASE WHEN c_acctbal > 8000 THEN 3 WHEN c_acctbal > 4000 THEN 2 ELSE 1 END, 'open': (c_acctbal <= 0)::INT, 'id': c_custkey::VARCHAR} AS rank FROM customer),
g AS (SELECT 0 AS k, []::VARCHAR[] AS ids, []::VARCHAR[] AS seen UNION ALL
  SELECT k + 1, list_append(any_value(ids), arg_max(id, (len(list_filter(marks, lambda m: NOT list_contains(seen, m))), rank))), list_concat(any_value(seen), arg_max(marks, (len(list_filter(marks, lambda m: NOT list_contains(seen, m))), rank)))
  FROM g, c WHERE k < 12 AND NOT list_contains(ids, id) GROUP BY k)
SELECT unnest(ids) AS question_id, generate_subscripts(ids, 1)::INT - 1 AS place FROM g WHERE k = 12"""
)
def stability_subset(spark, sf):
    c = td.table(spark, sf, "customer")
    hard = F.when(F.col("c_acctbal") > 8000, "hard").when(F.col("c_acctbal") > 4000, "medium").otherwise("easy")
    cases = c.select(F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("task_type"), (F.col("c_nationkey") % 5).alias("language"), (F.col("c_acctbal") > 0).alias("answerable"), hard.alias("difficulty"))
    return metrics.stability_subset(cases, 12)


_EVENT_SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 5}, "kind": {"enum": ["click", "view", "purchase"]}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 5}},
        "props": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 90}}},
    },
}


@query(
    """SELECT event_id AS line, '$.id: below 5' AS error FROM events WHERE event_id < 5 UNION ALL SELECT event_id, '$.kind: required' FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, '$.kind: ''' || event_type || ''' is not one of [''click'', ''view'', ''purchase'']' FROM events WHERE event_id % 7 <> 0 AND event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id, '$.tags[1]: longer than 5' FROM events WHERE length(event_type) > 5 UNION ALL SELECT event_id, '$.extra: not allowed' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT event_id, '$.props.k: above 90' FROM events WHERE regexp_extract(props, '([0-9]+)', 1)::INT > 90"""
)
def schema_violations(spark, sf):
    """Events as JSON records against a schema, compiled to columns."""
    e = F.col("event_id").cast("string")
    kind = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(', "kind": "'), "event_type", F.lit('"')))
    extra = F.when(F.col("event_id") % 11 == 0, ', "extra": null').otherwise("")
    text = F.concat(F.lit('{"id": '), e, kind, F.lit(', "tags": ["ok", "'), "event_type", F.lit('"], "props": '), "props", extra, F.lit("}"))
    return json_schema.schema_errors(td.table(spark, sf, "events").select(F.col("event_id").alias("line"), text.alias("value")), _EVENT_SCHEMA)


@query(
    """WITH r AS (SELECT s_suppkey AS k, 'r' || (s_suppkey % 95) AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'https://h/o/r/tree/main/x' ELSE 'https://h/o/r' END AS url,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'abc' ELSE repeat('a', 40) END AS sha, ['candidate', 'selected', 'cloned', 'indexed', 'other'][(s_suppkey % 5 + 1)::INT] AS state,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 8 = 0 THEN 'AGPL-3.0' ELSE 'MIT' END AS license FROM supplier)
SELECT 'clone_url_is_a_folder' AS rule, id AS key, '' AS detail FROM r WHERE url LIKE '%/tree/%' UNION ALL SELECT 'commit_sha_form', id, '' FROM r WHERE sha = 'abc' UNION ALL SELECT 'status_unknown', id, '' FROM r WHERE state = 'other'
UNION ALL SELECT 'cloned_without_commit', id, '' FROM r WHERE state IN ('cloned', 'indexed') AND sha IS NULL UNION ALL SELECT 'verified_without_counts', id, '' FROM r WHERE k % 3 = 0 AND k % 2 = 0
UNION ALL SELECT 'license_missing', id, '' FROM r WHERE url IS NOT NULL AND license IS NULL UNION ALL SELECT 'gpl_without_note', id, '' FROM r WHERE license LIKE '%GPL%' AND k % 16 = 0
UNION ALL SELECT 'subdir_is_no_string', id, '' FROM r WHERE k % 11 = 0 UNION ALL SELECT 'workspace_missing', id, '' FROM r WHERE state IN ('cloned', 'indexed') AND k % 95 % 3 <> 0
UNION ALL SELECT 'repo_id_repeated', id, count(*)::VARCHAR FROM r GROUP BY id HAVING count(*) > 1"""
)
def manifest_violations(spark, sf):
    """Suppliers as a manifest's repositories."""
    k, on = F.col("s_suppkey"), lambda n: F.col("s_suppkey") % n == 0
    text = lambda x: F.lit(x).cast("string")
    state = F.get(F.array(*[F.lit(x) for x in ("candidate", "selected", "cloned", "indexed", "other")]), (k % 5).cast("int"))
    repos = td.table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), (k % 95).cast("string")).alias("repo_id"), F.when(on(10), text(None)).when(on(7), "https://h/o/r/tree/main/x").otherwise("https://h/o/r").alias("clone_url"),
        F.when(on(4), text(None)).when(on(9), "abc").otherwise("a" * 40).alias("commit_sha"), state.alias("status"), on(3).alias("verified"), (~on(2)).alias("file_counts_verified"),
        F.when(on(6), text(None)).when(on(8), "AGPL-3.0").otherwise("MIT").alias("license"), F.when(on(16), text(None)).otherwise("noted").alias("license_note"),
        F.when(on(11), "5").otherwise('""').alias("repository_subdir"), text(None).alias("parent_repo"),
    )
    there = spark.range(0, 95, 3).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo_id"))
    return validate.manifest_rules(repos, there)
