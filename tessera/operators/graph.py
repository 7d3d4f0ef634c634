"""Bounded traversal of the entity graph: nodes (entity_id, ...) and edges (relation_id, source_id, target_id, relation_type, confidence)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.adjacency import Adjacency
from tessera.schema import CHAIN_TYPES, DomainError
from tessera.sources import places

MAX_DEPTH = 2
MAX_RESULTS = 30


def chain_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("relation_type").isin(*CHAIN_TYPES))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: at, other and the edge's own columns."""
    forth = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("other"), "relation_id")
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("other"), "relation_id")
    return forth.unionByName(back)


def _neighbours(nodes: DataFrame, edges: DataFrame, frontier: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``frontier`` (at and more columns, settled) with the edges at its nodes whose other end is known: other, relation_id.

    Both tables are met by what is settled, whose size Spark knows: a small one is broadcast, and no edge or node is shuffled
    or sorted but those found.
    """
    seen = settle(frontier.join(both_ways(edges), "at"))
    ends = settle(nodes.select(F.col("entity_id").alias("other")).join(seen.select("other").distinct(), "other", "left_semi").distinct())
    return seen.join(ends, "other", "left_semi")


def traverse(nodes: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, depth: int = MAX_DEPTH, relation_types: Sequence[str] | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(seed_id, entity_id, depth) and (seed_id, relation_id) of a breadth-first walk from each seed.

    ``edges`` is a table or an :class:`adjacency.Adjacency`, whose edges aren't shuffled.  Over a table, seeds and each
    level are settled by ``settle`` or in the session's shared folder.

    Edges are followed either way.  An edge belongs to the result once both its ends are known after
    the level that looked at it, so edges between two nodes of the last level don't.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError("depth must be 0, 1 or 2")
    if isinstance(edges, Adjacency):
        settle = lambda df: df
        step = lambda frontier: edges.step(frontier, relation_types)
    else:
        settle = settle or (lambda df: places.settled(df, "walk"))
        own = edges if relation_types is None else edges.filter(F.col("relation_type").isin(*relation_types))
        step = lambda frontier: _neighbours(nodes, own, frontier, settle)
    known = settle(seeds.select("seed_id", F.col("seed_id").alias("entity_id"), F.lit(0).alias("depth")))
    frontier = known
    looked = None
    for level in range(1, depth + 1):
        seen = step(frontier.select("seed_id", F.col("entity_id").alias("at"))).select("seed_id", F.col("other").alias("entity_id"), "relation_id")
        looked = seen if looked is None else looked.unionByName(seen)
        new = settle(seen.select("seed_id", "entity_id").distinct().join(known, ["seed_id", "entity_id"], "left_anti").withColumn("depth", F.lit(level)))
        known = known.unionByName(new)
        frontier = new
    if looked is None:
        looked = known.select("seed_id", F.lit(None).cast("long").alias("relation_id")).limit(0)
    return known, looked.select("seed_id", "relation_id").distinct()


def require_entity(nodes: DataFrame, entity_id: int) -> None:
    if not nodes.filter(F.col("entity_id") == entity_id).head(1):
        raise DomainError("ENTITY_NOT_FOUND", f"Entity {entity_id} does not exist.", 404)


def merge(walk: tuple[DataFrame, DataFrame], seed_order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of several walks: nodes keep the depth and place of their first walk; edges are distinct.

    ``seed_order`` has seed_id and place.
    """
    found = walk[0].join(seed_order, "seed_id")
    first = Window.partitionBy("entity_id").orderBy("place", "depth")
    nodes = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("entity_id", "depth", "place")
    return nodes, walk[1].select("relation_id").distinct()


def merge_by_id(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several walks' nodes and edges as an evaluation lists them: each once, nodes by id, edges by their ends, type and id."""
    own = nodes.dropDuplicates(["entity_id"]).orderBy("entity_id")
    return own, edges.dropDuplicates(["relation_id"]).orderBy("source_id", "target_id", "relation_type", "relation_id")


def references(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """The nodes (entity_id, depth, place) of a bounded result as numbered references: citation from 1 in the order
    of the walk (its seeds' places, then depth, then id), with what ``details`` knows of each entity."""
    order = Window.orderBy("place", "depth", "entity_id")  # one result, a bounded number of nodes
    return nodes.withColumn("citation", F.row_number().over(order)).join(details, "entity_id")


def api_matches(apis: DataFrame, method: str, normalized_path: str) -> DataFrame:
    """Backend APIs of exactly that method and path (columns http_method, normalized_path)."""
    return apis.filter((F.upper("http_method") == method.upper()) & (F.col("normalized_path") == normalized_path))


def graph_rag(nodes: DataFrame, edges: DataFrame, hits: DataFrame, depth: int = MAX_DEPTH, limit: int = MAX_RESULTS) -> DataFrame:
    """Hits (entity_id, score) and what chain edges reach from them, each entity once.

    A walk visits neighbours by (neighbour, relation) from nodes in the order they were reached, so the
    edge that discovers a node is the least by (place of its parent, relation).  Of several ways to an
    entity the least by (depth, -score, seed) stays.
    """
    names = nodes.select("entity_id", "qualified_name")
    typed = chain_edges(edges)
    around = both_ways(typed).join(nodes.select(F.col("entity_id").alias("other")), "other", "left_semi")
    level = hits.select(F.col("entity_id").alias("seed_id"), "score", "entity_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("relation_id"))
    known = level
    for d in range(1, depth + 1):
        seen = level.select("seed_id", "score", F.col("entity_id").alias("at"), "rank").join(around, "at")
        best = seen.groupBy("seed_id", "score", F.col("other").alias("entity_id")).agg(F.min(F.struct("rank", "relation_id")).alias("by"))
        new = best.join(known.select("seed_id", "entity_id"), ["seed_id", "entity_id"], "left_anti")
        order = Window.partitionBy("seed_id").orderBy("by.rank", "entity_id")
        level = new.select("seed_id", "score", "entity_id", F.lit(d).alias("depth"), F.row_number().over(order).cast("long").alias("rank"), F.col("by.relation_id").alias("relation_id"))
        known = known.unionByName(level)
    first = Window.partitionBy("entity_id").orderBy("depth", F.desc("score"), "seed_id")
    kept = known.withColumn("__n", F.row_number().over(first)).filter("__n = 1").orderBy("depth", F.desc("score"), "entity_id").limit(limit)
    ends = typed.select("relation_id", "source_id", "target_id", "relation_type")
    out = kept.join(ends, "relation_id", "left")
    for side in ("source", "target"):
        out = out.join(names.select(F.col("entity_id").alias(f"{side}_id"), F.col("qualified_name").alias(f"{side}_name")), f"{side}_id", "left")
    reason = F.when(F.col("relation_id").isNull(), "direct hybrid-search hit").otherwise(F.concat_ws(" ", "source_name", "relation_type", "target_name"))
    return out.select("entity_id", "seed_id", F.col("depth").alias("graph_depth"), F.col("score").alias("retrieval_score"), reason.alias("relation_reason"))


def chain_paths(edges: DataFrame) -> DataFrame:
    """Calls with their API and, where there are, one handler of it and what that calls."""
    by = lambda t, a, b: edges.filter(F.col("relation_type") == t).select(F.col("source_id").alias(a), F.col("target_id").alias(b))
    handler = by("DEFINES_API", "api_id", "handler_id").groupBy("api_id").agg(F.max("handler_id").alias("handler_id"))
    return by("REQUESTS_API", "call_id", "api_id").join(handler, "api_id", "left").join(by("CALLS_METHOD", "handler_id", "method_id"), "handler_id", "left")


def missing_relation_types(edges: DataFrame) -> DataFrame:
    """Chain relation types that a graph lacks, in their fixed order."""
    present = edges.agg(F.collect_set("relation_type").alias("seen"))
    wanted = F.array(*[F.lit(t) for t in CHAIN_TYPES])
    return present.select(F.posexplode(wanted).alias("place", "relation_type"), "seen").filter(~F.array_contains("seen", F.col("relation_type"))).select("place", "relation_type")
