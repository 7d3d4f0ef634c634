"""A posting index for substring search: the same hits as :func:`search.keyword_search`, without reading all texts.

Entities get slots 0, 1, 2, ... in the order of their ids; 64 slots are a block.  A posting says for one gram
(one, two or three folded characters in a row, or a whole name) and one block which entities have it, as 64 bits for each
field.  A term's grams are looked up and their bits are ANDed, which gives each block's candidates and the best score
that each may have.  Then candidates are read, best first, and scored as a scan would, by literal
containment, until none that is left can reach the hits found: the threshold algorithm.  So terms that
nearly every text holds need no more reading than rare ones.

Both tables are partitioned (postings by a hash of the gram, rows by ranges of slots) and sorted inside, so that a
query opens the folders of its grams and candidates alone, and in them the row groups whose statistics fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.lexical import FIELDS, field_score, fold, folded, lexical_score, parse_terms

BLOCK = 64
GRAM = 3
#: Slots of one folder of rows, and folders of postings.
PART, SHARDS = 1 << 16, 64
#: Characters of a text whose grams are looked at in one go.
CHUNK = 1 << 20
#: Candidates of a first read; each later one takes four times as many.
FIRST_READ = 64
#: Before a whole name stands this, which no folded text's gram begins with three of.
_WHOLE = "\x00="


def _shard_of(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SHARDS


def grams_of(term: str) -> list[str]:
    """The grams that a text must have to hold ``term``."""
    size = min(GRAM, len(term))
    return list(dict.fromkeys(term[i : i + size] for i in range(len(term) - size + 1)))


def _codes(text: str) -> np.ndarray:
    """The different grams of one to three characters, each as one number: 21 bits a character, the first in the highest."""
    found = np.empty(0, np.int64)
    for low in range(0, len(text), CHUNK):
        chars = np.frombuffer(text[low : low + CHUNK + GRAM - 1].encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        own = chars << 42
        parts = [own[:CHUNK]]
        for k in range(1, GRAM):
            own = own[:-1] | (chars[k:] << (42 - 21 * k))
            parts.append(own[:CHUNK])
        found = np.unique(np.concatenate([found, *parts]))
    return found


def _gram_of(code: int) -> str:
    return "".join(chr(c - 1) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def _block_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (slot, folded fields) by gram and block; rows of a block that are no neighbours give several."""

    def posted(block: int, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        codes = np.concatenate([c for _, _, c in held])
        grams, place = np.unique(codes, return_inverse=True)
        bits = np.zeros((len(FIELDS), len(grams)), np.uint64)
        low = 0
        for field, bit, own in held:  # the codes of one text differ, so none is met twice here
            bits[field, place[low : low + len(own)]] |= np.uint64(1 << bit)
            low += len(own)
        columns = [pa.array([_gram_of(c) for c in grams.tolist()], pa.string()), pa.array(np.full(len(grams), block)), *(pa.array(b.view(np.int64)) for b in bits)]
        return pa.RecordBatch.from_arrays(columns, ["gram", "block", *FIELDS])

    for batch in batches:
        at, held = None, []
        for slot, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and slot // BLOCK != at:
                yield posted(at, held)
                held = []
            at = slot // BLOCK
            held += [(i, slot % BLOCK, _codes(t)) for i, t in enumerate(texts) if t]
        if held:
            yield posted(at, held)


def slotted(entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """``entities`` with ``slot``: their number in the order of ``key``, from 0; the counts of sorted ranges come first."""
    ranges = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = entities.select(key).repartitionByRange(ranges, key)
    parts = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.count("*").alias("n"), F.min(key).alias("low")).collect()  # one row a range
    parts.sort(key=lambda r: r["range"])
    lows, before, total = [], [], 0
    for r in parts:
        lows.append(r["low"])
        before.append(total)
        total += r["n"]
    if not lows:
        return entities.withColumn("slot", F.lit(0).cast("long"))
    # the last range that begins at or before the key, by halving; its rows are numbered by a window of their own
    bounds, starts = F.array(*[F.lit(x) for x in lows]), F.array(*[F.lit(x) for x in before])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(lows).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < len(lows)) & (F.get(bounds, at + s) <= F.col(key)), at + s).otherwise(at))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(key)) - 1
    return entities.withColumn("range_", place).withColumn("slot", (F.get(starts, F.col("range_")) + inside).cast("long")).drop("range_")


def build(entities: DataFrame, rows_path: str, postings_path: str, key: str = "entity_id") -> None:
    """Write the rows, with the folded fields that lower case alone doesn't give, and the postings of ``entities``.

    Ids are unique.  One pass folds and writes the rows, sorted by slot; a second joins the entities of a block where
    they are read, so that what is shuffled are postings, not the grams of each text.
    """
    spark = entities.sparkSession
    if not entities.head(1):  # a partitioned table of nothing has no file that keeps its columns
        none = entities.withColumns({f"rest_{c}": F.col(c) for c in FIELDS}).withColumns({"slot": F.lit(0).cast("long"), "part": F.lit(0)})
        none.limit(0).write.parquet(rows_path)
        spark.createDataFrame([], "gram string, block long, " + ", ".join(f"{c} long" for c in (*FIELDS, "whole")) + ", shard int").write.parquet(postings_path)
        return
    fields = folded(entities, *FIELDS)
    rest = [F.when(F.col(f"folded_{c}") != F.lower(F.coalesce(F.col(c), F.lit(""))), F.col(f"folded_{c}")).alias(f"rest_{c}") for c in FIELDS]
    rows = slotted(fields.select(*entities.columns, *rest), key).withColumn("part", F.floor(F.col("slot") / PART).cast("int"))
    # a given number of ranges isn't put together again, so that the second pass has as many files to read
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "slot").sortWithinPartitions("part", "slot").write.partitionBy("part").option("parquet.block.size", 8 << 20).parquet(rows_path)
    stored = _folded_again(spark.read.parquet(rows_path))
    none = F.lit(0).cast("long")
    parts = stored.select("slot", *[f"folded_{c}" for c in FIELDS]).mapInArrow(_block_postings, "gram string, block long, " + ", ".join(f"{c} long" for c in FIELDS)).withColumn("whole", none)
    names = stored.select(F.concat(F.lit(_WHOLE), F.col("folded_name")).alias("gram"), F.floor(F.col("slot") / BLOCK).cast("long").alias("block"), *[none.alias(c) for c in FIELDS], F.expr(f"shiftleft(1L, int(slot % {BLOCK}))").alias("whole"))
    postings = parts.unionByName(names).groupBy("gram", "block").agg(*[F.bit_or(c).alias(c) for c in (*FIELDS, "whole")])
    postings = postings.withColumn("shard", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(SHARDS)).cast("int"))
    postings.repartitionByRange("shard", "gram", "block").sortWithinPartitions("shard", "gram", "block").write.partitionBy("shard").option("parquet.block.size", 4 << 20).parquet(postings_path)


def _folded_again(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"folded_{c}": F.coalesce(F.col(f"rest_{c}"), F.lower(F.coalesce(F.col(c), F.lit("")))) for c in FIELDS}).drop(*[f"rest_{c}" for c in FIELDS])


@dataclass
class Reading:
    """What a search read: blocks with candidates, candidates scored, and reads."""

    blocks: int = 0
    scored: int = 0
    reads: int = 0


class TermIndex:
    """Searches over the tables that :func:`build` wrote; ``reading`` tells what the last search read."""

    def __init__(self, rows: DataFrame, postings: DataFrame, key: str = "entity_id") -> None:
        self.rows, self.postings, self.key, self.reading = rows, postings, key, Reading()
        self.columns = [c for c in rows.columns if c not in ("slot", "part") and not c.startswith("rest_")]

    @classmethod
    def at(cls, spark: SparkSession, folder: str, key: str = "entity_id") -> TermIndex:
        return cls(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/postings"), key)

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """block and ``terms``: for each term and field the bits of the entities that have all its grams there."""
        number = {g: i for i, g in enumerate(dict.fromkeys(g for t in terms for g in [*grams_of(t), _WHOLE + t]))}
        numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
        found = self.postings.filter(F.col("shard").isin(*{_shard_of(g) for g in number}) & F.col("gram").isin(*number))
        held = found.select("block", F.struct(F.element_at(numbers, F.col("gram")).alias("g"), *FIELDS, "whole").alias("bits")).groupBy("block").agg(F.collect_list("bits").alias("held"))
        zero, ones = F.lit(0).cast("long"), F.lit(-1).cast("long")

        def bits(term: str) -> Column:
            own = [number[g] for g in grams_of(term)]
            begin = F.struct(F.lit(0).alias("n"), *[ones.alias(c) for c in FIELDS], zero.alias("whole"))

            def step(a: Column, x: Column) -> Column:
                mine = x["g"].isin(*own)
                both = [F.when(mine, a[c].bitwiseAND(x[c])).otherwise(a[c]).alias(c) for c in FIELDS]
                return F.struct((a["n"] + mine.cast("int")).alias("n"), *both, F.when(x["g"] == number[_WHOLE + term], x["whole"]).otherwise(a["whole"]).alias("whole"))

            # a field has the term only if the block has a posting of each gram
            end = lambda a: F.struct(*[F.when(a["n"] == len(own), a[c]).otherwise(zero).alias(c) for c in FIELDS], a["whole"].alias("whole"), F.lit(term.startswith("/")).alias("path_like"))
            return F.aggregate("held", begin, step, end)

        return held.select("block", F.array(*[bits(t) for t in terms]).alias("terms"))

    def _bounded(self, terms: Sequence[str], digits: int | None) -> DataFrame:
        """slot and bound: the best score that an entity may have, by the scan's own formula."""
        rows = self.candidates(terms).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))))

        def score(x: Column) -> Column:
            name, qualified, metadata, path, content, whole = (F.getbit(x[c], F.col("at")) == 1 for c in (*FIELDS, "whole"))
            found = F.when(whole, 1.0).when(qualified, 0.9).when(x["path_like"] & (metadata | name), 0.85)
            return found.when(name, 0.75).when(path, 0.6).when(content, 0.4).otherwise(0.0)

        rows = rows.select((F.col("block") * BLOCK + F.col("at")).alias("slot"), F.transform("terms", score).alias("scores"))
        bound = lexical_score(terms, scores=[F.get("scores", F.lit(i)) for i in range(len(terms))])
        return rows.select("slot", (bound if digits is None else F.round(bound, digits)).alias("bound")).filter("bound > 0")

    def top(self, terms: Sequence[str], limit: int = 10, digits: int | None = None, where: Column | None = None) -> DataFrame:
        """The best entities with ``score``, above 0, ties by id: what :func:`search.lexical_top` gives on the filtered entities."""
        spark = self.rows.sparkSession
        self.reading = Reading()
        shape = self.rows.select(*self.columns).withColumn("score", F.lit(0.0)).schema
        if not terms or limit < 1:
            return spark.createDataFrame([], shape)
        bounds = self._bounded(terms, digits)
        score = lexical_score(terms)
        exact = _folded_again(self.rows).select("*", *[field_score(t).alias(f"term_{i}") for i, t in enumerate(terms)])
        exact = exact.withColumn("score", score if digits is None else F.round(score, digits))
        if where is not None:
            exact = exact.filter(where)
        best: list = []
        take, last = max(FIRST_READ, 2 * limit), None
        while True:
            unseen = bounds if last is None else bounds.filter((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("slot") > last[1])))
            some = unseen.orderBy(F.desc("bound"), "slot").limit(take).collect()  # at most ``take`` numbers
            self.reading.reads += 1
            self.reading.scored += len(some)
            if some:
                last = (some[-1]["bound"], some[-1]["slot"])
                slots = [r["slot"] for r in some]
                self.reading.blocks += len({s // BLOCK for s in slots})
                hits = exact.filter(F.col("part").isin(*{s // PART for s in slots}) & F.col("slot").isin(*slots)).select("slot", "score").collect()
                best = sorted([*best, *((-r["score"], r["slot"]) for r in hits if r["score"] > 0)])[:limit]
            if len(some) < take or len(best) == limit and best[-1] < (-last[0], last[1] + 1):
                break
            take *= 4
        if not best:
            return spark.createDataFrame([], shape)
        chosen = [s for _, s in best]
        hits = self.rows.filter(F.col("part").isin(*{s // PART for s in chosen}) & F.col("slot").isin(*chosen))
        scores = F.element_at(F.create_map(*[F.lit(x) for s, slot in best for x in (slot, -s)]), F.col("slot"))
        return hits.select(*self.columns, scores.alias("score")).orderBy(F.desc("score"), self.key)

    def search(self, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        """What :func:`search.keyword_search` gives: a structured query falls back to its parts only if nothing has it whole."""
        terms = parse_terms(query) or (["\\"] if query.strip() == "\\" else [])
        if len(terms) < 2 or terms[0] != fold(query.strip()):
            return self.top(terms, limit, where=where)
        found = self.top(terms[:1], limit, where=where)
        return found if found.head(1) else self.top(terms[1:], limit, where=where)
