"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to unit length and turned by a seeded random rotation, or by several side by side
where its dimension is below ``BITS``, which is an isometry to more dimensions; its code keeps one sign
bit a dimension, packed, with two correction scalars: the vector's length and the inner product of the
turned vector with its own code.  From these the inner product with a query is estimated without bias,
with an error bound that shrinks with the number of bits.

The search takes two passes over grids of bounded cells (candidate slot x query slot), so neither side
is ever held whole.  The first carries codes alone and keeps each query's ``FLOOR_FACTOR * k`` largest
estimates; their exact products, from a join with the original vectors, give a floor: the k-th best of
them, which the k-th best of all can't be below.  In the second only vectors whose upper bound reaches
the query's floor are reranked on the original vectors in doubles.

Every row is indexed.  Null vectors, zero vectors and vectors with null or non-finite components take
no part; vectors meet only others of their dimension; rows with a null id take no part, rows that
repeat an id count once (the least of its vectors); ties go to the smaller id; an empty table gives no
rows; columns beyond the two are not read, and there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SEED = 20
BITS = 256
BOUND = 3.0
FLOOR_FACTOR = 4
SLOTS = 64
SLOT_ROWS = 65_536
QUERY_ROWS = 32_768
CODE_SLOTS = 8
CODE_SLOT_ROWS = 1 << 18


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices side by side, ``BITS`` columns at least, scaled to keep lengths; the same in every task."""
    blocks = max(1, -(-BITS // dim))
    random, out = np.random.default_rng([seed, dim]), []
    for _ in range(blocks):
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out) / np.sqrt(blocks)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, length, inner product of turned unit vector and its code)."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def estimate(queries: np.ndarray, turn: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and the half-widths of their error bounds."""
    bits = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    raw = (queries @ turn).astype(np.float32) @ signs.T / np.float32(np.sqrt(bits))
    spread = length * np.sqrt(np.maximum(0.0, 1 - own**2)) / own * bound / np.sqrt(max(bits - 1, 1))
    return raw * (length / own), np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-5 * length * np.linalg.norm(queries, axis=1)[:, None]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in doubles, summed in the order of the dimensions, so equal vectors score alike."""
    out = np.zeros(len(vectors))
    for j, x in enumerate(query):
        out += vectors[:, j] * x
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
            turn = turns.setdefault(dim, rotation(dim))
            codes, length, own = encode(_matrix(part.column("embedding")), turn)
            out = part.append_column("code", pa.array([x.tobytes() for x in codes], pa.binary()))
            yield from out.append_column("length", pa.array(length)).append_column("own", pa.array(own)).to_batches()


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, embedding, code, length and own of every usable vector."""
    shared.shared_dir(vectors.sparkSession)
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(e).cast("int").alias("dim"), e.alias("embedding"))
    e = F.col("embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.col("dim") > 0)).filter(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    return rows.mapInArrow(_index, "vec_id long, dim int, embedding array<double>, code binary, length double, own double")


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids in order, packed codes, lengths and correction scalars."""
    ids = table.column("vec_id").to_numpy()
    at = np.argsort(ids)
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)[at]
    return ids[at], codes, table.column("length").to_numpy()[at], table.column("own").to_numpy()[at]


def _blocks(queries: pa.Table, codes: tuple, bound: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, query, estimates, error bounds, places of others) of each query against the codes of one cell."""
    asked, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("embedding"))
    ids, packed, length, own = codes
    turn = rotation(q.shape[1])
    for low in range(0, len(asked), 128):
        guess, error = estimate(q[low : low + 128], turn, packed, length, own, bound)
        for i in range(len(guess)):
            yield low + i, q[low + i], guess[i], error[i], ids != asked[low + i]


def _best_guesses(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("guess", pa.float64())])

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return schema.empty_table()
        codes = _codes(found)
        asked, out = queries.column("vec_id").to_numpy(), []
        for i, _, guess, _, rest in _blocks(queries, codes, 0.0):
            guess = np.where(rest, guess, -np.inf)
            best = np.argpartition(-guess, k)[:k] if len(guess) > k else np.arange(len(guess))
            best = best[rest[best]]
            out.append((np.full(len(best), asked[i]), codes[0][best], guess[best].astype(np.float64)))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema)

    return search


def _rerank(k: int, bound: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("slot", pa.int32()), ("reranked", pa.int64())])

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return schema.empty_table()
        codes = _codes(found)
        vectors = _matrix(found.column("embedding"))[np.argsort(found.column("vec_id").to_numpy())]
        asked, floors, out = queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy(zero_copy_only=False), []
        slot = found.column("slot")[0].as_py()
        for i, query, guess, error, rest in _blocks(queries, codes, bound):
            near = np.flatnonzero(rest & (guess + error >= floors[i]))
            score = products(vectors[near], query)
            best = np.lexsort((codes[0][near], -score))[:k]
            out.append((np.full(len(best), asked[i]), codes[0][near][best], score[best], np.full(len(best), slot, np.int32), np.full(len(best), len(near))))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema)

    return search


def _grid(candidates: DataFrame, queries: DataFrame, slots: int, asks: int, search, kinds: str) -> DataFrame:
    """``search`` of each cell of candidates (dealt to ``slots``) and queries (dealt to ``asks``) of one dimension."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = candidates.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int")).withColumn("ask", each(asks))
    asked = queries.withColumn("ask", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(asks)).cast("int")).withColumn("slot", each(slots))
    cell = ["dim", "slot", "ask"]
    return asked.groupBy(*cell).cogroup(found.groupBy(*cell)).applyInArrow(search, kinds)


def _first(rows: DataFrame, k: int, by: str) -> DataFrame:
    """Each query's ``k`` rows with the largest ``by``, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, bound: float = BOUND) -> DataFrame:
    """query_id, vec_id, score, slot, reranked: each query's ``k`` best of each slot, and how many of the slot were reranked for it."""
    coded = shared.settle(index(vectors), "codes")
    if coded.groupBy("vec_id").count().filter("count > 1").head(1):
        least = F.min(F.struct("dim", "embedding", "code", "length", "own")).alias("x")
        coded = shared.settle(coded.groupBy("vec_id").agg(least).select("vec_id", "x.*"), "codes")
    n, m = coded.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    queries = coded.filter(is_query).select("vec_id", "dim", "embedding")
    codes = coded.drop("embedding")
    guesses = _grid(codes, queries, max(CODE_SLOTS, -(-n // CODE_SLOT_ROWS)), max(CODE_SLOTS, -(-m // QUERY_ROWS)), _best_guesses(FLOOR_FACTOR * k), "query_id long, vec_id long, guess double")
    guesses = _first(guesses, FLOOR_FACTOR * k, "guess").select("query_id", "vec_id")
    pairs = guesses.join(coded.select("vec_id", F.col("embedding").alias("x")), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("y")), "query_id")
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    floors = _first(pairs.select("query_id", "vec_id", exact.alias("score")), k, "score").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    asked = shared.settle(queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    return _grid(coded, asked, max(SLOTS, -(-n // SLOT_ROWS)), max(1, -(-m // QUERY_ROWS)), _rerank(k, bound), "query_id long, vec_id long, score double, slot int, reranked long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, bound: float = BOUND) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query's others."""
    return _first(search(vectors, is_query, k, bound), k, "score").select("query_id", "rank", "vec_id", "score")
