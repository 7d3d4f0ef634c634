"""Edges stored from both ends, bucketed and sorted by node, so that walks don't shuffle them.

A node's edges lie in one bucket, sorted, so a frontier is joined by a merge that shuffles the frontier alone, or, where
it is small, by a broadcast of it.  Nodes with more than ``HUB`` edges are hubs: their edges stand in a
table of their own, bucketed by node and slice, and a hub in the frontier is asked slice by slice, so that no task holds
all edges of a hub.  Edges whose other end is unknown are left out when the layout is built.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a node above which it is a hub, and slices of a hub.
HUB, SLICES = 100_000, 64
_COLUMNS = "at long, other long, relation_id long, relation_type string, confidence double"


class Adjacency:
    """The layout below ``folder``: tables plain (buckets by ``at``), hubs (by ``at`` and ``slice``) and hub_nodes."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, hub_count: int) -> None:
        self.spark, self.folder, self.buckets, self.hub_count, self.names = spark, folder.rstrip("/"), buckets, hub_count, []
        self.plain = self._table("plain", _COLUMNS, "at")
        self.hubs = self._table("hubs", f"{_COLUMNS}, slice int", "at, slice")

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Adjacency:
        about = spark.read.parquet(f"{folder}/about").first()
        return cls(spark, folder, about["buckets"], about["hubs"])

    def _table(self, name: str, columns: str, by: str) -> DataFrame:
        """The files of a table under a name that follows from their folder, as buckets are known by the catalog alone."""
        own = f"adjacency_{name}_{hashlib.sha256(self.folder.encode()).hexdigest()[:24]}"
        self.names.append(own)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own} ({columns.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(own)

    def close(self) -> None:
        """Forget the names; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def step(self, frontier: DataFrame, relation_types: Sequence[str] | None = None) -> DataFrame:
        """``frontier`` (at and more columns) joined with the edges of its nodes: other, relation_id, relation_type, confidence."""
        of = lambda df: df if relation_types is None else df.filter(F.col("relation_type").isin(*relation_types))
        out = frontier.join(of(self.plain), "at")
        if not self.hub_count:
            return out
        known = self.spark.read.parquet(f"{self.folder}/hub_nodes")
        asked = frontier.join(known, "at").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        return out.unionByName(asked.join(of(self.hubs), ["at", "slice"]).drop("slice"))


def build(spark: SparkSession, nodes: DataFrame, edges: DataFrame, folder: str, buckets: int | None = None, hub: int = HUB) -> Adjacency:
    """Write the layout of ``edges`` (relation_id, source_id, target_id, relation_type, confidence) between ``nodes`` (entity_id)."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    forth = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("other"), "relation_id", "relation_type", "confidence")
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("other"), "relation_id", "relation_type", "confidence")
    both = forth.unionByName(back).join(nodes.select(F.col("entity_id").alias("other")).distinct(), "other", "left_semi").select(*(c.split()[0] for c in _COLUMNS.split(", ")))
    both.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("at").write.parquet(f"{folder}/hub_nodes")
    known = spark.read.schema("at long").parquet(f"{folder}/hub_nodes")

    def write(df: DataFrame, name: str, *by: str) -> None:
        own = f"building_{uuid.uuid4().hex}"
        df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{folder}/{name}").saveAsTable(own)
        spark.sql(f"DROP TABLE {own}")  # the files stay, as their path was given

    write(both.join(known, "at", "left_anti"), "plain", "at")
    write(both.join(known, "at", "left_semi").withColumn("slice", F.pmod(F.xxhash64("relation_id", "other"), F.lit(SLICES)).cast("int")), "hubs", "at", "slice")
    spark.createDataFrame([(buckets, known.count())], "buckets int, hubs long").coalesce(1).write.parquet(f"{folder}/about")
    return Adjacency.at(spark, folder)
