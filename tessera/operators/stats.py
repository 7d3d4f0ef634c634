"""Counts, cross tables and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def project_stats(files: DataFrame, entities: DataFrame, relations: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: file and line totals and maps of counts by language, entity, relation and issue type."""

    def counts(df: DataFrame, key: str, name: str) -> DataFrame:
        pairs = df.groupBy(key).agg(F.count("*").alias("n"))
        return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
    for df, key, name in ((files, "language", "languages"), (entities, "entity_type", "entity_types"), (relations, "relation_type", "relation_types"), (issues, "issue_type", "issue_types")):
        out = out.crossJoin(counts(df, key, name))
    return out


def ranked_counts(df: DataFrame, key: str, *sums: str) -> DataFrame:
    """n and sums by ``key``, most frequent first (place from 1, ties by key); the last row, ``*``, has the totals."""
    cells = [F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums]]
    by = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(*cells)
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # one row a value
    return by.unionByName(df.agg(*cells).select(F.lit("*").alias(key), "n", *sums, F.lit(0).alias("place")))


def matched_relations(edges: DataFrame, relation_type: str = "REQUESTS_API") -> DataFrame:
    """One row: relations of a type, and the distinct calls among their sources (the first figure counts a call once for each API)."""
    return edges.filter(F.col("relation_type") == relation_type).agg(F.count("*").alias("relations"), F.count_distinct("source_id").alias("calls"))


def scan_summary(files: DataFrame, entities: DataFrame, relations: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, entities and relations indexed, files skipped and parse errors."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    bad = issues.agg(F.count_if(F.col("issue_type") == "skipped").alias("files_skipped"), F.count_if(F.col("issue_type") == "parse_error").alias("parse_errors"))
    return n(files, "files_indexed").crossJoin(n(entities, "entities_indexed")).crossJoin(n(relations, "relations_indexed")).crossJoin(bad)


def matched_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: identified, matched and unmatched calls (call_id); edges have source_id."""
    hit = calls.join(edges.select(F.col("source_id").alias("call_id")), "call_id", "left_semi").agg(F.count("*").alias("matched"))
    all_ = calls.agg(F.count("*").alias("identified"))
    return all_.crossJoin(hit).withColumn("unmatched", F.col("identified") - F.col("matched"))


def unmatched_calls(calls: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return calls.join(edges.select(F.col("source_id").alias("call_id")), "call_id", "left_anti").orderBy("call_id").limit(limit)


def cross_table(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of every (row, column), of rows, of columns and of all; margins read ``*``, nulls ``unknown``."""
    named = df.select(F.coalesce(F.col(row).cast("string"), F.lit("unknown")).alias("r"), F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("c"))
    cube = named.cube("r", "c").agg(F.count("*").alias("n"), F.grouping("r").alias("gr"), F.grouping("c").alias("gc"))
    return cube.select(F.when(F.col("gr") == 1, "*").otherwise(F.col("r")).alias("row_value"), F.when(F.col("gc") == 1, "*").otherwise(F.col("c")).alias("column_value"), "n")


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: accuracy and the mean F1 over expected labels."""
    cells = confusion(df, expected, predicted)
    label = cells.select(F.col("expected").alias("label")).distinct()
    hit = cells.filter("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("tp"))
    rows = cells.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("have"))
    cols = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    out = label.join(hit, "label", "left").join(rows, "label", "left").join(cols, "label", "left").na.fill(0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("have") + F.col("said"))).otherwise(0.0)
    return out.agg((F.sum("tp") / F.sum("have")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, p50, p95 (linear between neighbours), total and max."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.sum(v).alias("total"), F.max(v).alias("longest"))


def grid(df: DataFrame, dimensions: Sequence[str], variant: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates for each value of each dimension and each variant; nulls read ``<missing>``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("<missing>")).alias("value")) for d in dimensions]))
    return df.withColumn("__cell", pairs).groupBy("__cell.dimension", "__cell.value", variant).agg(*aggregates)
