"""Deriving edges from entities by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INVOCATIONS = "array<struct<qualifier:string,method:string,receiver_type:string>>"


def request_edges(calls: DataFrame, apis: DataFrame) -> DataFrame:
    """Calls (call_key, path, method) joined with APIs (api_key, path, method): the same method at 1.0,
    else, where a call has none of these, an API for any method at 0.8."""
    calls = calls.filter(F.col("path").isNotNull() & F.col("method").isNotNull()).withColumn("method", F.upper("method"))
    apis = apis.filter(F.col("path").isNotNull() & F.col("method").isNotNull()).withColumn("method", F.upper("method"))
    exact = calls.join(apis, ["path", "method"]).select("call_key", "api_key", F.lit(1.0).alias("confidence"))
    open_ = calls.join(apis.select("path", "method"), ["path", "method"], "left_anti")
    any_ = open_.select("call_key", "path").join(apis.filter("method = 'ANY'").select("path", "api_key"), "path")
    return exact.unionByName(any_.select("call_key", "api_key", F.lit(0.8).alias("confidence")))


def call_edges(invocations: DataFrame, methods: DataFrame, services: DataFrame) -> DataFrame:
    """Invocations (source_key, method, qualifier, receiver_type) resolved to service methods
    (target_key, class_name, method) if exactly one fits.

    A receiver type names a service by its full or its simple name (confidence 0.8); without one the
    method's name must be unique among all service methods (0.6).
    """
    simple = F.element_at(F.split("class_name", r"\."), -1)
    alias = services.select("class_name", F.explode(F.array_distinct(F.array("class_name", simple))).alias("receiver_type")).distinct()
    methods = methods.join(services.select("class_name").distinct(), "class_name", "left_semi")
    by_type = alias.join(methods, "class_name").groupBy("receiver_type", "method").agg(F.count("*").alias("n"), F.min("target_key").alias("target_key")).filter("n = 1")
    by_name = methods.groupBy("method").agg(F.count("*").alias("n"), F.min("target_key").alias("target_key")).filter("n = 1")
    typed = invocations.filter("receiver_type is not null").join(by_type.drop("n"), ["receiver_type", "method"])
    plain = invocations.filter("receiver_type is null").join(by_name.drop("n"), "method")
    pick = lambda df, c, r: df.select("source_key", "target_key", F.lit(c).alias("confidence"), F.lit(r).alias("resolution"), "qualifier")
    return pick(typed, 0.8, "receiver_type").unionByName(pick(plain, 0.6, "unique_method_name"))


def first_of_each(relations: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first relation of each (source, target, type): parsed ones come before derived ones."""
    w = Window.partitionBy("source_key", "target_key", "relation_type").orderBy(order)
    return relations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_of_each(entities: DataFrame, key: str = "local_key", order: str = "ordinal") -> DataFrame:
    """The last entity of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entities.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def resolve_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Keys to ids at both ends; relations with an unknown end are dropped."""
    out = relations
    for side in ("source", "target"):
        out = out.join(entities.select(F.col("local_key").alias(f"{side}_key"), F.col("id").alias(f"{side}_id")), f"{side}_key")
    return out


def derive(entities: DataFrame, parsed: DataFrame) -> DataFrame:
    """All relations of a project: parsed ones and those that joins find (schema RELATION)."""
    meta = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    of = lambda t: entities.filter(F.col("entity_type") == t)
    keys = lambda df, name: df.select(F.col("local_key").alias(name), meta("normalized_path").alias("path"), meta("http_method").alias("method"))
    requests = request_edges(keys(of("frontend_api_call"), "call_key"), keys(of("backend_api"), "api_key"))
    services = of("java_class").filter(meta("is_service") == "true").select(F.col("qualified_name").alias("class_name"))
    methods = of("java_method").select(F.col("local_key").alias("target_key"), meta("declaring_class").alias("class_name"), F.col("name").alias("method"))
    calls = of("java_method").select(F.col("local_key").alias("source_key"), F.inline(F.from_json(meta("invocations"), INVOCATIONS)))
    calls = call_edges(calls.filter("method is not null"), methods, services)
    link = F.to_json(F.struct("qualifier", "resolution"))
    found = [
        parsed.withColumn("ordinal", F.lit(0)),
        requests.select(F.col("call_key").alias("source_key"), F.col("api_key").alias("target_key"), F.lit("REQUESTS_API").alias("relation_type"), "confidence", F.lit("{}").alias("metadata_json"), F.lit(1).alias("ordinal")),
        calls.select("source_key", "target_key", F.lit("CALLS_METHOD").alias("relation_type"), "confidence", link.alias("metadata_json"), F.lit(2).alias("ordinal")),
    ]
    return first_of_each(found[0].unionByName(found[1]).unionByName(found[2])).drop("ordinal")


def receiver_types(invocations: DataFrame, services: DataFrame) -> DataFrame:
    """Frequency of each receiver type among the invocations, and whether it names a service."""
    simple = services.select(F.explode(F.array("class_name", F.element_at(F.split("class_name", r"\."), -1))).alias("receiver_type")).distinct().withColumn("known", F.lit(True))
    by = invocations.filter("receiver_type is not null").groupBy("receiver_type").agg(F.count("*").alias("n"))
    return by.join(simple, "receiver_type", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def resolution_funnel(invocations: DataFrame, methods: DataFrame, services: DataFrame) -> DataFrame:
    """Invocations by outcome: resolved, unknown receiver type, or unresolved method."""
    resolved = call_edges(invocations.withColumn("qualifier", F.col("invocation_id").cast("string")), methods, services).select(F.col("qualifier").cast("long").alias("invocation_id"), F.lit(1).alias("ok"))
    simple = services.select(F.explode(F.array("class_name", F.element_at(F.split("class_name", r"\."), -1))).alias("receiver_type")).distinct().withColumn("known", F.lit(1))
    out = invocations.join(resolved, "invocation_id", "left").join(simple, "receiver_type", "left")
    reason = F.when(F.col("ok") == 1, "resolved").when(F.col("receiver_type").isNotNull() & F.col("known").isNull(), "receiver_not_a_service").otherwise("method_not_unique_or_missing")
    return out.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
