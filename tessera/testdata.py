"""The data model laid over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import line_count
from tessera.operators import term_index, vector_index
from tessera.sources import places

NATION, CUSTOMER, ORDER = 100, 1_000, 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities of project 1."""
    d = table(spark, sf_dir, "documents")
    ident = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        F.lit(1).cast("long").alias("project_id"), F.col("doc_id").alias("entity_id"), F.col("source").alias("entity_type"), ident.alias("name"),
        F.concat_ws(".", "source", "lang", ident).alias("qualified_name"), F.concat(F.concat_ws("/", "source", "lang", ident), F.lit(".txt")).alias("file_path"),
        F.lit(1).alias("start_line"), line_count(F.col("text")).alias("end_line"), F.col("text").alias("content"),
        F.concat(F.lit('{"lang": "'), "lang", F.lit('", "n_chars": '), F.col("n_chars").cast("string"), F.lit("}")).alias("metadata_json"),
    )


#: Indexes that this process has built, by application and folder of tables.
_BUILT: dict[tuple, object] = {}


def terms_of(spark: SparkSession, sf_dir: str) -> term_index.TermIndex:
    """The entities' term index, built at its first use in a session."""
    key = ("terms", spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        folder = places.fresh(spark, "terms")
        term_index.build(entities(spark, sf_dir), f"{folder}/rows", f"{folder}/postings")
        _BUILT[key] = term_index.TermIndex.at(spark, folder)
    return _BUILT[key]


def cells_of(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The vectors' cells, built at their first use in a session."""
    key = ("cells", spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        folder = places.fresh(spark, "cells")
        vector_index.build(vectors(spark, sf_dir), f"{folder}/vectors", f"{folder}/cells")
        _BUILT[key] = vector_index.VectorIndex.at(spark, folder)
    return _BUILT[key]


ENT = """ent AS (SELECT 1::BIGINT AS project_id, doc_id AS entity_id, source AS entity_type, 'doc_' || doc_id AS name,
  source || '.' || lang || '.doc_' || doc_id AS qualified_name, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path,
  text AS content, '{"lang": "' || lang || '", "n_chars": ' || n_chars || '}' AS metadata_json FROM documents)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as nodes with disjoint ids."""
    t = lambda n: table(spark, sf_dir, n)
    pick = lambda df, key, base, kind: df.select((F.col(key).cast("long") + base).alias("entity_id"), F.concat(F.lit(kind + "_"), F.col(key).cast("string")).alias("qualified_name"))
    out = pick(t("region"), "r_regionkey", 1, "region").unionByName(pick(t("nation"), "n_nationkey", NATION, "nation"))
    return out.unionByName(pick(t("customer"), "c_custkey", CUSTOMER, "customer")).unionByName(pick(t("orders"), "o_orderkey", ORDER, "order"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed edges; a relation has its source's id."""
    t = lambda n: table(spark, sf_dir, n)
    pick = lambda df, a, base_a, b, base_b, kind, c: df.select((F.col(a).cast("long") + base_a).alias("relation_id"), (F.col(a).cast("long") + base_a).alias("source_id"), (F.col(b).cast("long") + base_b).alias("target_id"), F.lit(kind).alias("relation_type"), F.lit(c).alias("confidence"))
    out = pick(t("orders"), "o_orderkey", ORDER, "o_custkey", CUSTOMER, "REQUESTS_API", 1.0)
    out = out.unionByName(pick(t("customer"), "c_custkey", CUSTOMER, "c_nationkey", NATION, "DEFINES_API", 1.0))
    return out.unionByName(pick(t("nation"), "n_nationkey", NATION, "n_regionkey", 1, "CALLS_METHOD", 0.8))


GRAPH = f"""nodes AS (SELECT r_regionkey::BIGINT + 1 AS entity_id, 'region_' || r_regionkey AS qualified_name FROM region
  UNION ALL SELECT n_nationkey::BIGINT + {NATION}, 'nation_' || n_nationkey FROM nation
  UNION ALL SELECT c_custkey::BIGINT + {CUSTOMER}, 'customer_' || c_custkey FROM customer
  UNION ALL SELECT o_orderkey::BIGINT + {ORDER}, 'order_' || o_orderkey FROM orders),
edges AS (SELECT o_orderkey::BIGINT + {ORDER} AS relation_id, o_orderkey::BIGINT + {ORDER} AS source_id, o_custkey::BIGINT + {CUSTOMER} AS target_id, 'REQUESTS_API' AS relation_type, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT c_custkey::BIGINT + {CUSTOMER}, c_custkey::BIGINT + {CUSTOMER}, c_nationkey::BIGINT + {NATION}, 'DEFINES_API', 1.0 FROM customer
  UNION ALL SELECT n_nationkey::BIGINT + {NATION}, n_nationkey::BIGINT + {NATION}, n_regionkey::BIGINT + 1, 'CALLS_METHOD', 0.8 FROM nation),
around AS (SELECT source_id AS here, target_id AS other, relation_id, relation_type FROM edges UNION ALL SELECT target_id, source_id, relation_id, relation_type FROM edges)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector comes to the driver as the query."""
    return vectors(spark, sf_dir).filter(F.col("entity_id") == vec_id).first()["embedding"]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: every event is an attempt; those that aren't signups also finish, errors as failures."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("attempt_id"), "event_type", "user_id", F.abs("value").alias("latency_seconds"))
    nothing = F.lit(None).cast("string")
    start = e.select("attempt_id", "user_id", F.lit("started").alias("event"), nothing.alias("outcome"), F.lit(None).cast("double").alias("latency_seconds"))
    end = e.filter("event_type <> 'signup'").select("attempt_id", "user_id", F.lit("finished").alias("event"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), "latency_seconds")
    return start.unionByName(end)


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by price as its prediction, its urgent and high ones as gold; two variants."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "o_orderkey"))), lambda x: x["o_orderkey"])
    gold = F.array_sort(F.collect_list(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey"))))
    rows = o.groupBy(F.col("o_custkey").alias("question_id"), "c_mktsegment").agg(
        listed((-F.col("o_totalprice")).alias("k")).alias("by_price"), listed(F.col("o_orderdate").alias("k")).alias("by_date"), gold.alias("gold")
    )
    variant = F.explode(F.array(F.struct(F.lit("W70").alias("variant"), F.col("by_price").alias("predicted")), F.struct(F.lit("W80").alias("variant"), F.col("by_date").alias("predicted"))))
    return rows.select("question_id", "c_mktsegment", "gold", variant.alias("v")).select("question_id", "c_mktsegment", "gold", "v.variant", "v.predicted")


RANK = """rank AS (SELECT o_custkey AS question_id, c_mktsegment, variant, predicted, gold FROM (
  SELECT o_custkey, c_mktsegment, list(o_orderkey ORDER BY -o_totalprice, o_orderkey) AS by_price, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS by_date,
    coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), []) AS gold
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) t,
  LATERAL (SELECT 'W70' AS variant, t.by_price AS predicted UNION ALL SELECT 'W80', t.by_date) v)"""
FIRST = "list_min(list_filter(list_transform(gold, lambda g: list_position(predicted, g)), lambda p: p IS NOT NULL AND p > 0))"
