"""Lexical, vector and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lexical import fold, folded, lexical_score, parse_terms, term_scores

HIT = ("entity_id", "entity_type", "name", "qualified_name", "file_path", "start_line", "end_line", "content", "metadata_json")
VECTOR_WEIGHT = 0.75
RRF_K = 60


def top(scored: DataFrame, limit: int, tie: str = "entity_id") -> DataFrame:
    """Best scores first, ties by id or another column, such as a stable key."""
    return scored.orderBy(F.desc("score"), tie).limit(limit)


def lexical_top(entities: DataFrame, terms: Sequence[str], limit: int = 10, digits: int | None = None) -> DataFrame:
    """The best entities with ``score``, above 0.  The filter stands after the limit, so texts are scored once."""
    score = lexical_score(terms)
    scored = term_scores(entities, terms).withColumn("score", score if digits is None else F.round(score, digits))
    return top(scored.select(*[F.col(f"`{c}`") for c in entities.columns], "score"), limit).filter("score > 0")


def keyword_search(entities: DataFrame, query: str, limit: int = 10, digits: int | None = None) -> DataFrame:
    """Entities that match, scored; a structured query falls back to its parts only if nothing has it whole."""
    terms = parse_terms(query)
    if not terms:
        terms = ["\\"] if query.strip() == "\\" else []
    if not terms:
        return entities.withColumn("score", F.lit(0.0)).limit(0)
    if len(terms) == 1 or terms[0] != fold(query.strip()):
        return lexical_top(entities, terms, limit, digits)
    # both scores in one pass: rows that have the query whole come first, so the others go if there is one
    scored = term_scores(entities, terms).withColumn("whole", F.col("term_0") > 0)
    scored = scored.withColumn("score", F.when(F.col("whole"), F.col("term_0")).otherwise(lexical_score(terms[1:], 1)))
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    best = scored.select(*[F.col(f"`{c}`") for c in entities.columns], "score", "whole").orderBy(F.desc("whole"), F.desc("score"), "entity_id").limit(limit)
    found = best.withColumn("found", F.max("whole").over(Window.partitionBy()))
    return found.filter((F.col("whole") == F.col("found")) & (F.col("score") > 0)).drop("whole", "found")


def token_baseline(files: DataFrame, tokens: Sequence[str], limit: int = 10) -> DataFrame:
    """Files by the share of distinct query tokens they hold: file_path, matched, occurrences, score."""
    text = F.col("lowered")
    found = [F.floor((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in tokens]
    counts = files.select("file_path", F.lower("content").alias("lowered")).select("file_path", F.array(*found).alias("n"))
    out = counts.select("file_path", F.size(F.filter("n", lambda x: x > 0)).alias("matched"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("occurrences"))
    out = out.withColumn("score", F.round(F.col("matched") / len(tokens), 4))
    return out.orderBy(F.desc("score"), "file_path").limit(limit).filter("matched > 0")


def keyword_baseline(entities: DataFrame, tokens: Sequence[str], limit: int = 10) -> DataFrame:
    """Per token the best 3 * limit hits, folded by file: tokens matched, best score, first hit's id.

    All tokens are scored in one pass; the best of each token are cut before the shuffle.
    """
    scored = term_scores(entities, tokens).select("entity_id", "file_path", F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"term_{i}").alias("score")) for i, t in enumerate(tokens)])).alias("x"))
    order = Window.partitionBy("token").orderBy(F.desc("score"), "entity_id")
    hits = scored.select("entity_id", "file_path", "x.*").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 3 * limit).filter("score > 0")
    by = hits.groupBy("file_path").agg(F.count_distinct("token").alias("n_tokens"), F.max("score").alias("best"), F.min_by("entity_id", F.struct(-F.col("score"), "entity_id")).alias("entity_id"))
    return by.orderBy(F.desc("n_tokens"), F.desc("best"), "file_path").limit(limit)


def first_by_file(hits: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first hit of each (query_id, file_path)."""
    w = Window.partitionBy("query_id", "file_path").orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def chunk_text(most: int = 4000) -> Column:
    """Searchable text of an entity."""
    labels = [("Type: ", "entity_type"), ("Name: ", "name"), ("Qualified name: ", "qualified_name"), ("File: ", "file_path"), ("Metadata: ", "metadata_json")]
    return F.concat_ws("\n", *[F.concat(F.lit(a), F.coalesce(F.col(c), F.lit(""))) for a, c in labels], F.lit("Code:"), F.substring("content", 1, most))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int = 10, digits: int | None = None) -> DataFrame:
    """entity_id and cosine score of the nearest vectors (entity_id, embedding); the query is a literal."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col("embedding").cast("array<double>"), literal)
    return top(vectors.withColumn("score", score if digits is None else F.round(score, digits)).drop("embedding"), limit)


def _branches(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    v = vector.select("entity_id", F.col("score").alias("v"))
    k = keyword.select("entity_id", F.col("score").alias("k"))
    return v.join(k, "entity_id", "full_outer")


def positive_scaled(column: str) -> Column:
    """Score over the branch's largest positive score; 0 if not positive.  Branches are bounded by their limits."""
    best = F.max(F.when(F.col(column) > 0, F.col(column))).over(Window.partitionBy())
    return F.when(F.col(column) > 0, F.col(column) / best).otherwise(0.0)


def weighted_fusion(vector: DataFrame, keyword: DataFrame, limit: int = 10, vector_weight: float = VECTOR_WEIGHT, digits: int | None = None) -> DataFrame:
    """Weighted sum of both branches' scaled scores, best first, ties by id."""
    both = _branches(vector, keyword).select("entity_id", positive_scaled("v").alias("v"), positive_scaled("k").alias("k"))
    score = F.col("v") * vector_weight + F.col("k") * (1 - vector_weight)
    return top(both.select("entity_id", (score if digits is None else F.round(score, digits)).alias("score")), limit)


def weight_sweep(vector: DataFrame, keyword: DataFrame, weights: Sequence[float], limit: int = 10, digits: int | None = None) -> DataFrame:
    """weight, entity_id and score: the weighted fusion's best for each of ``weights`` from one pass over the branches."""
    both = _branches(vector, keyword).select("entity_id", positive_scaled("v").alias("v"), positive_scaled("k").alias("k"))
    swept = both.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    score = F.col("v") * F.col("weight") + F.col("k") * (1 - F.col("weight"))
    order = Window.partitionBy("weight").orderBy(F.desc("score"), "entity_id")
    swept = swept.withColumn("score", score if digits is None else F.round(score, digits)).withColumn("place", F.row_number().over(order))
    return swept.filter(F.col("place") <= limit).select("weight", "entity_id", "score")


def degraded(vector: DataFrame | None, keyword: DataFrame | None, limit: int = 10) -> DataFrame:
    """The best of the branch that is left, with ``source`` naming the fallback."""
    source, left = ("keyword_fallback", keyword) if vector is None else ("vector_fallback", vector)
    return top(left.select("entity_id", "score"), limit).withColumn("source", F.lit(source))


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the branches (entity_id, score)."""
    order = Window.orderBy(F.desc("score"), "entity_id")
    ranked = [b.select("entity_id", (F.lit(1.0) / (k + F.row_number().over(order))).alias("part")) for b in (vector, keyword)]
    return top(ranked[0].unionByName(ranked[1]).groupBy("entity_id").agg(F.sum("part").alias("score")), limit)


def branch_diagnostics(vector: DataFrame, keyword: DataFrame, fused: DataFrame, k: int = 10) -> DataFrame:
    """One row: sizes of the branches, their overlap, what only keywords found, and whether fusion changed the first k."""

    def ids(df: DataFrame, name: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity_id"))), lambda x: x["entity_id"])
        return df.agg(listed.alias(name))

    rows = ids(vector, "v").crossJoin(ids(keyword, "k")).crossJoin(ids(fused, "f"))
    return rows.select(
        F.size("v").alias("vector_count"), F.size("k").alias("keyword_count"), F.size(F.array_intersect("v", "k")).alias("overlap"),
        F.size(F.array_except("k", "v")).alias("keyword_only"), (F.slice("v", 1, k) != F.slice("f", 1, k)).alias("top_changed"),
    )
