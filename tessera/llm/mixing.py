"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (rows wanted in all) * (its share of the target weights) / (its
rows).  Every document draws its number of copies by inverting that Poisson distribution at a uniform
value hashed from a seed and its id, so a lost task draws the same again; rates above ``PART`` are
split into independent parts so that no probability underflows.  Copies are exploded and shuffled
globally by a hash of (seed, id, copy): partitions are random and each is sorted by that hash.

A null source is a source of its own; null ids share one draw, as rows that repeat do; sources without
a weight are left out; texts are neither read nor cut, however long, null or empty; columns of the input
pass through (those named like the three added ones are replaced); an empty table gives no rows.  Rates are
broadcast only after a count of the sources; beyond ``MOST_BROADCAST`` they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SEED = "mix-1"
PART = 64.0
MOST_BROADCAST = 20_000
TEMPERATURE = 0.5


def uniform(seed: str, *keys: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits of an MD5."""
    word = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """Poisson distribution function at 0, 1, ... as an array, until it can't grow in doubles."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(a["all"], F.array(F.element_at(a["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]


def rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = TEMPERATURE, rows_out: int | None = None) -> DataFrame:
    """source, rate: mean copies of each source's documents.

    ``weights`` (source, weight) are the targets; without them a source weighs its rows to the power ``temperature``.
    """
    sized = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        sized = sized.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        sized = sized.join(weights.select(F.col("source").alias("__s"), "weight"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    sized = shared.settle(sized, "sources")
    n, weight = sized.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(rows_out if rows_out is not None else n or 0)
    return sized.select("source", F.round(F.lit(wanted) * F.col("weight") / F.lit(float(weight or 1)) / F.col("n"), 9).alias("rate"))


def replicate(docs: DataFrame, rate: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: str = SEED, shuffle: bool = True, names: tuple[str, str, str] = ("copies", "copy", "shuffle_key")) -> DataFrame:
    """``docs``, each row as often as it drew, with the columns ``names``: copies drawn, number of the copy (from 1) and shuffle key."""
    many, number, order = names
    docs = docs.select(*[shared.col(c) for c in docs.columns if c not in names])
    own, split, below, drawn = shared.unused([*docs.columns, *names], "own_source", "parts", "below", "drawn")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = rate.select(F.col("source").alias(own), parts.alias(split), cumulative(F.col("rate") / parts).alias(below))
    few = rate.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = docs.join(F.broadcast(table) if few else table, F.col(source).eqNullSafe(F.col(own)))
    # one hash a part, before the search in the distribution
    joined = joined.withColumn(drawn, F.transform(F.sequence(F.lit(1), F.col(split)), lambda part: uniform(seed, F.col(doc_id), part)))
    copies = F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter(below, lambda x: x <= u)))
    joined = joined.withColumn(many, copies).filter(F.col(many) > 0)
    out = joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(many))))
    out = out.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(number).cast("string")).cast("binary")))
    out = out.drop(own, split, below, drawn)
    return out.repartition(order).sortWithinPartitions(order) if shuffle else out
