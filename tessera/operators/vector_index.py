"""Vectors in coarse cells: the exact nearest by cosine, without reading all vectors.

Each vector, scaled to length one, lies in the cell of its nearest centre and is stored with its distance to it; a
cell's table row has its centre, its radius (the largest such distance) and its size.  By the triangle inequality no
vector of a cell is nearer to a query than the query's distance to the centre less the radius, and in the cell
none whose own distance to the centre differs from the query's by more than the hits' distance can be
among them.  So cells are read nearest first until enough hits are known, then those cells, and the rows in them, that
the bound leaves.  What is read is scored as a scan would score it, so the hits are the scan's.

Vectors without a length have cosine 0 to everything and a cell of their own, whose bound is that score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import cosine, norm, top

#: Vectors that centres are fitted on at most, rounds of fitting, and the most centres.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 2048
#: Cell of the vectors without a length.
NOWHERE = -1
#: Room for rounding in the bounds.
SLACK = 1e-9


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """``cells`` centres of a bounded sample of unit vectors, by spherical k-means from evenly drawn rows."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        good = length > 0
        centres[good] = sums[good] / length[good, None]
    return np.unique(centres, axis=0)


def _assign(centres: np.ndarray, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            unit = values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, centres.shape[1]))
            length = np.sqrt((unit * unit).sum(axis=1))
            some = length > 0
            unit = unit / np.where(some, length, 1)[:, None]
            cell = (unit @ centres.T).argmax(axis=1) if len(batch) else np.zeros(0, np.int64)
            far = np.sqrt(((unit - centres[cell]) ** 2).sum(axis=1))
            cell, far = np.where(some, cell, NOWHERE), np.where(some, far, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(far), pa.array(cell.astype(np.int32))], [key, "embedding", "far", "cell"])

    return run


def build(vectors: DataFrame, vectors_path: str, cells_path: str, key: str = "entity_id", cells: int | None = None) -> None:
    """Write ``vectors`` (key, embedding of one dimension, finite) by cells, and the cells' table.

    Centres are fitted on at most ``SAMPLE`` vectors, chosen by the hash of their keys; every vector is assigned.
    """
    spark = vectors.sparkSession
    picked = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    n = picked.count()
    if not n:  # a partitioned table of nothing has no file that keeps its columns
        picked.withColumns({"far": F.lit(0.0), "cell": F.lit(0)}).write.parquet(vectors_path)
        spark.createDataFrame([], "cell int, radius double, n long, centre array<double>").write.parquet(cells_path)
        return
    fit = picked.filter(norm(F.col("embedding")) > 0).select("embedding", F.xxhash64(key).alias("luck")).orderBy("luck").limit(SAMPLE).select("embedding").toPandas()["embedding"]  # bounded
    dim = len(picked.first()["embedding"])
    sample = np.stack(fit.tolist()) if len(fit) else np.zeros((0, dim))
    sample = sample / np.linalg.norm(sample, axis=1)[:, None] if len(fit) else sample
    wanted = cells or max(1, min(MOST_CELLS, int(math.sqrt(n))))
    centres = fit_centres(sample, min(wanted, len(sample))) if len(sample) else np.zeros((1, dim))
    kind = picked.schema[key].dataType.simpleString()
    placed = picked.mapInArrow(_assign(centres, key), f"{key} {kind}, embedding array<double>, far double, cell int")
    # ranges of (cell, far), so that a crowded cell has several files, each with its own span of distances
    placed.repartitionByRange("cell", "far").sortWithinPartitions("cell", "far").write.partitionBy("cell").option("parquet.block.size", 4 << 20).parquet(vectors_path)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = spark.read.parquet(vectors_path).groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    sizes.join(F.broadcast(table), "cell", "left").coalesce(1).write.parquet(cells_path)


@dataclass
class Reading:
    """What a search read of the index: cells of all, and vectors of all (by the cells' sizes, before rows in them are pruned)."""

    cells: int = 0
    of_cells: int = 0
    vectors: int = 0
    of_vectors: int = 0


class VectorIndex:
    """Searches over the tables that :func:`build` wrote; ``reading`` tells what the last search read."""

    def __init__(self, vectors: DataFrame, cells: DataFrame, key: str = "entity_id") -> None:
        self.vectors, self.key, self.reading = vectors, key, Reading()
        self.cells = cells.collect()  # at most MOST_CELLS + 1 rows

    @classmethod
    def at(cls, spark: SparkSession, folder: str, key: str = "entity_id") -> VectorIndex:
        return cls(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/cells"), key)

    def _score(self, query: Sequence[float], digits: int | None) -> Column:
        score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
        return score if digits is None else F.round(score, digits)

    def search(self, query: Sequence[float], limit: int = 10, digits: int | None = None) -> DataFrame:
        """key and cosine score of the ``limit`` nearest vectors, ties by key: what a scan of all gives."""
        q = np.array(query, float)
        length = float(np.linalg.norm(q))
        unit = q / length if length else q
        apart = {c["cell"]: float(np.linalg.norm(unit - np.array(c["centre"]))) if c["centre"] is not None else 0.0 for c in self.cells}
        # the least distance that a vector of the cell may have; cosine 0 is a distance of the root of two
        near = {c["cell"]: max(0.0, apart[c["cell"]] - c["radius"]) if c["cell"] != NOWHERE and length else math.sqrt(2) if length else 0.0 for c in self.cells}
        order = sorted(self.cells, key=lambda c: (near[c["cell"]], apart[c["cell"]], c["cell"]))
        first, held = [], 0
        for c in order:
            if held >= limit and len(first) >= 2:
                break
            first.append(c["cell"])
            held += c["n"]
        # the limit-th of some vectors bounds the distance of the hits
        known = self._read(first).select(self._score(query, None).alias("score")).orderBy(F.desc("score")).limit(limit).collect()
        worst = known[-1]["score"] if len(known) == limit else -1.0
        room = math.sqrt(max(0.0, 2 - 2 * worst)) + SLACK + (10.0 ** -digits if digits is not None else 0.0)
        cells = [c["cell"] for c in order if near[c["cell"]] <= room]
        self.reading = Reading(len(cells), len(self.cells), sum(c["n"] for c in self.cells if c["cell"] in set(cells)), sum(c["n"] for c in self.cells))
        rows = self._read(cells)
        if length:
            spot = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c, apart[c])]), F.col("cell")) if cells else F.lit(0.0)
            rows = rows.filter((F.col("cell") == NOWHERE) | (F.abs(F.col("far") - spot) <= room))
        return top(rows.select(self.key, self._score(query, digits).alias("score")), limit, self.key)

    def _read(self, cells: Sequence[int]) -> DataFrame:
        return self.vectors.filter(F.col("cell").isin(*cells)) if cells else self.vectors.limit(0)
