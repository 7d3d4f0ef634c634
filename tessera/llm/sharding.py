"""Sharding: balanced label propagation on the graph that links equal texts.

Every linked document starts in the shard its id's hash names; a unit is what one group of equal texts
has in one of ``shards * CHUNKS`` hash classes, so a group of any size, a third of all rows included, is
a bounded number of units.  In each round a unit moves towards the shard where most of its group's
bytes are, among those with room left, and a shard takes movers (in hash order, by exact running sums)
only up to its quota.  As the groups are cliques, a window over a group's units is the join of a unit
with its neighbours.  Documents without links, which cut no edge anywhere, are then dealt in hash
order to the room that is left of each shard's equal share of all bytes.  At last single documents
(short ones first), then others, move from shards above the mean to those below it along running sums,
until no shard is more than a thousandth above the mean, a pass gains nothing or ``PASSES`` passes are
done; ``fill``, the shard's bytes as a multiple of the mean, says what was reached (documents aren't
split, so a few documents a shard can't be even).  Only DataFrame operations are used; running sums
are taken in two levels (sums of hash ranges, then within a range), so no task holds a whole shard.

Null text has no bytes and the checksum of the empty text; texts count whole, however long; rows that
repeat are placed each; null ids are placed like any other id; ties go by id, then by text hash; an
empty table gives no rows; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 24
CHUNKS = 8
ROUNDS = 4
FILL = 0.98
LEAST_ROOM = 0.02
PASSES = 6
NEAR = 1.001
RANGE_ROWS = 50_000


def running(df: DataFrame, key: str, order: str, ids: list[str], value: Column, bits: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``key`` that come before in ``order``.

    ``order`` is a long in [0, 2**63).  The broadcast side has at most (number of keys) * 2**bits rows.
    """
    df = df.withColumn("__range", F.shiftright(order, 63 - bits)).withColumn("__value", value)
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, "__range").agg(F.sum("__value").alias("__sum"))
    sums = sums.select(key, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__range").orderBy(order, *ids).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(sums), [key, "__range"])
    return out.withColumn(name, F.col("__base") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).drop("__range", "__value", "__base")


def _loads(df: DataFrame, size: str, shards: int) -> list[int]:
    """Bytes of each shard; one row a shard comes to the driver."""
    found = {r[0]: int(r[1]) for r in df.groupBy("shard").agg(F.sum(size)).collect()}
    return [found.get(j, 0) for j in range(shards)]


def _lookup(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), key + 1)


def propagate(units: DataFrame, target: float, shards: int, rounds: int) -> DataFrame:
    """``units`` (grp, chunk, bytes, shard) after label propagation under quotas of ``FILL * target`` bytes a shard."""
    for _ in range(rounds):
        room = [max(0, int(FILL * target) - x) for x in _loads(units, "bytes", shards)]
        if max(room) <= LEAST_ROOM * target:
            break
        here = F.sum("bytes").over(Window.partitionBy("grp", "shard"))
        wanted = F.max(F.when(_lookup([x > LEAST_ROOM * target for x in room], F.col("shard")), F.struct("here", (-F.col("shard")).alias("label")))).over(Window.partitionBy("grp"))
        aim = units.withColumn("here", here).withColumn("wanted", wanted)
        better = (F.col("wanted.here") > F.col("here")) | ((F.col("wanted.here") == F.col("here")) & (-F.col("wanted.label") < F.col("shard")))
        aim = aim.withColumn("dest", F.when(better, -F.col("wanted.label")).otherwise(F.lit(-1)))
        aim = shared.settle(aim.select("grp", "chunk", "bytes", "shard", "dest", F.shiftrightunsigned(F.xxhash64("grp"), 1).alias("luck")), "aims")
        movers = running(aim.filter("dest >= 0"), "dest", "luck", ["grp", "chunk"], F.col("bytes"), 6, "before")
        fits = F.col("before") + F.col("bytes") <= _lookup(room, F.col("dest"))
        moved = movers.select("grp", "chunk", "bytes", F.when(fits, F.col("dest")).otherwise(F.col("shard")).alias("shard"), fits.alias("moved"))
        moved = shared.settle(moved.unionByName(aim.filter("dest < 0").select("grp", "chunk", "bytes", "shard", F.lit(False).alias("moved"))), "units")
        units = moved.drop("moved")
        if not moved.filter("moved").head(1):
            break
    return units


def deal(loose: DataFrame, room: list[int], total: int, bits: int) -> DataFrame:
    """Adds ``shard`` to documents (size, luck): in hash order to the room of each shard, as parts of all room."""
    edge, ends = sum(room), []
    for x in room:
        ends.append((ends[-1] if ends else 0) + x)
    found = running(loose.withColumn("all", F.lit(0)), "all", "luck", ["doc_id", "grp"], F.col("size"), bits, "before")
    spot = F.col("before") * F.lit(edge / max(1, total))
    shard = F.lit(len(room) - 1)
    for j in reversed(range(len(room) - 1)):
        shard = F.when(spot < ends[j], F.lit(j)).otherwise(shard)
    return found.withColumn("shard", shard.cast("int")).drop("all", "before")


def level(placed: DataFrame, loads: list[int], bits: int) -> DataFrame:
    """Moves documents (size, shard, turn: the order in which they may go) from full to empty shards."""
    mean = sum(loads) / len(loads)
    over = [max(0, int(x - mean)) for x in loads]
    under = [max(0, int(mean - x)) for x in loads]
    base = [sum(over[:j]) for j in range(len(over))]
    scale = sum(under) / max(1, sum(over))
    found = running(placed, "shard", "turn", ["doc_id", "grp"], F.col("size"), bits, "before")
    spot = (_lookup(base, F.col("shard")) + F.col("before")) * F.lit(scale)
    dest, edge = F.col("shard"), sum(under)
    for j in reversed(range(len(under))):
        if under[j]:
            dest = F.when(spot < edge, F.lit(j)).otherwise(dest) if dest is not None else F.lit(j)
            edge -= under[j]
    goes = F.col("before") + F.col("size") <= _lookup(over, F.col("shard"))
    return found.withColumn("shard", F.when(goes, dest).otherwise(F.col("shard")).cast("int")).drop("before")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard) and fill of every row."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text, size, crc).alias("grp"))
    base = base.withColumn("luck", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1))
    base = shared.settle(base.withColumn("chunk", F.pmod("luck", F.lit(shards * CHUNKS)).cast("int")), "sized")
    rows, total = base.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(1.0).alias("fill"))
    bits = min(12, max(4, (rows // (shards * RANGE_ROWS)).bit_length()))
    parts = base.groupBy("grp", "chunk").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    linked = F.sum("n").over(Window.partitionBy("grp"))
    units = parts.withColumn("linked", linked).filter("linked > 1").select("grp", "chunk", "bytes", (F.col("chunk") % shards).alias("shard"))
    units = propagate(shared.settle(units, "units"), total / shards, shards, rounds)
    placed = shared.settle(base.join(units.select("grp", "chunk", "shard"), ["grp", "chunk"], "left"), "placed")
    held = _loads(placed.filter("shard is not null"), "size", shards)
    room = [max(0, int(total / shards) - x) for x in held]
    loose = deal(placed.filter("shard is null").drop("shard"), room, total - sum(held), min(16, bits + 5))
    even = placed.filter("shard is not null").withColumn("linked", F.lit(True)).unionByName(loose.withColumn("linked", F.lit(False)))
    even = shared.settle(even.withColumn("shard", F.col("shard").cast("int")), "dealt")
    loads = _loads(even, "size", shards)
    for _ in range(PASSES):
        if max(loads) <= NEAR * total / shards:
            break
        small = F.col("size") <= (max(loads) - total / shards) / 8
        late = F.when(F.col("linked"), 2).when(small, 0).otherwise(1).cast("long")
        moved = shared.settle(level(even.withColumn("turn", F.shiftright("luck", 2) + F.shiftleft(late, 61)), loads, bits).drop("turn"), "level")
        now = _loads(moved, "size", shards)
        if max(now) >= max(loads):
            shared.discard(moved)
            break
        shared.discard(even)
        even, loads = moved, now
    out = running(even, "shard", "luck", ["doc_id", "grp"], F.lit(1).cast("long"), bits, "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", _lookup([x * shards / total for x in loads], F.col("shard")).alias("fill"))
