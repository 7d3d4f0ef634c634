"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct shingles (``n`` words in a row, ASCII lower case;
fewer words: the whole sequence).  All sets are ordered by one global order, rare shingles first: a
shingle is as frequent as the rarest of its words, counted over all documents.  If two sets reach the
similarity, then for every level l their prefixes of size - ceil(threshold * size) + l shingles share l
at least.  Each set takes the level whose estimated cost is least, from the lengths of its prefix
shingles' posting lists: more levels, longer prefixes, but more shared shingles asked for before a
pair is verified on whole sets.

Equal sets collapse before, so copies make no pairs.  Sparse linking comes first: within a posting list
the sets with one min-hash, as near copies mostly have, meet their pivot (the set with the fewest rarer
shingles) and their neighbours in a chain, and then, where components are left in a list, one set of each meets one of
the next; that is linear in the postings, and a group of near copies becomes one component without making all its pairs.  What is left meets in the token join: only lists
with different components, cut into bands of sizes that can link, without sets that have fewer open
shingles than their level asks for, and only pairs that their own required overlap and their parity
signatures allow.  No link between different components is lost.

A shingle that many sets share never comes to one task: where a task sees more than ``HOT`` postings
of it, they are dealt by set instead of by shingle; later joins by shingle have one row a shingle on
one side or can be split by Spark.

Null or wordless text has an empty set and links with nothing; rows that repeat are one set; documents
without an id link like others but lend no id; an empty table gives no rows; texts are read whole, in
bounded pieces, however long; columns beyond doc_id and text pass through ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .textkernel import LOWER, Tables, mix, rows, signed, words

LEVELS = 4
VERIFY_COST = 50
FREQUENT = 1 << 20
CHAIN = 500
FLUSH = 1 << 21
#: Postings of one shingle in a flush beyond which they are dealt by set too.
HOT = 64
#: Rounds of components before the last links are known: enough for stars and short chains.
PARTIAL = 3
SIGNATURE = [f"s{i}" for i in range(32)]
MINIMA = ["m0", "m1"]
#: The signature folded to a quarter, for the token join.
FOLDED = [f"f{i}" for i in range(8)]


def row_key():
    """Rows alike in id and text share a key; rows that only share an id don't."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sets_of(value: np.ndarray, word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each word, and for each row where its shingles end."""
    total = len(value)
    code = np.zeros(total, dtype=np.uint64)
    for j in range(n):
        code[: max(total - j, 0)] = mix(code[: max(total - j, 0)] + value[j:]) if j else mix(value + np.uint64(n))
    count = np.diff(word_off)
    stop = word_off[:-1] + np.maximum(count - n + 1, 0)
    for i in np.flatnonzero((count > 0) & (count < n)):
        low, high = word_off[i], word_off[i + 1]
        x = np.uint64(0x51 + high - low)
        for k in range(low, high):
            x = mix(value[k : k + 1] + x)[0]
        code[low], stop[i] = x, low + 1
    return code, stop


def _identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return int(signed(mix(s).sum(dtype=np.uint64, keepdims=True))[0]), int(signed(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64, keepdims=True))[0])


def signature(s: np.ndarray) -> np.ndarray:
    """2048 bits: the parity of the shingles in each hash class.

    Sets that differ in d shingles differ in at most d bits.
    """
    bits = np.bincount((s >> np.uint64(53)).astype(np.int64), minlength=2048) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def minima(s: np.ndarray) -> list[int]:
    """Min-hashes under fixed permutations of 64 bits."""
    return [int(signed(mix(s ^ np.uint64(0x9E3779B97F4A7C15 + 2 * i)).min(keepdims=True))[0]) for i in range(len(MINIMA))]


def _facts(n: int):
    """Per row its set's identity and size; per task the number of rows that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        names = ["key", "doc_id", "n", "a", "b", *SIGNATURE, *MINIMA]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return word, np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

        for part, data, offsets in rows(batches):
            _, _, value, word_off = words(LOWER[data], offsets, tables)
            code, stop = sets_of(value, word_off, n)
            size, first, second = [], [], []
            seen = []
            signs = np.zeros((part.num_rows, len(SIGNATURE)), np.int64)
            least = np.zeros((part.num_rows, len(MINIMA)), np.int64)
            for i in range(part.num_rows):
                s = np.unique(code[word_off[i] : stop[i]])
                signs[i] = signature(s)
                if len(s):
                    least[i] = minima(s)
                one, two = _identity(s) if len(s) else (None, None)
                size.append(len(s))
                first.append(one)
                second.append(two)
                seen.append(np.unique(value[word_off[i] : word_off[i + 1]]))
            if seen:
                held.append(np.unique(np.concatenate(seen), return_counts=True))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [merged()]
                if len(held[0][0]) > FLUSH // 2:
                    yield _counts(*held[0], names)
                    held = []
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), *(pa.array(x) for x in signs.T.copy()), *(pa.array(x) for x in least.T.copy())], names)
        if held:
            yield _counts(*merged(), names)

    return run


def _counts(word: np.ndarray, count: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Word counts in the rows' schema: n below zero marks them."""
    nothing = pa.nulls(len(word), pa.int64())
    return pa.RecordBatch.from_arrays([nothing, nothing, pa.array(-count), pa.array(signed(word)), nothing, *[nothing] * (len(SIGNATURE) + len(MINIMA))], names)


def _postings(n: int, percent: int, buckets: int, order):
    """Prefix shingles of each set: blobs of (shingle, set, size, place) by shingle range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        known, frequency = order.value
        least = -(-percent // (100 - percent))  # smaller sets link with equal ones only
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            token, owner, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.lexsort((owner, token))
            token, owner, size, place = token[at], owner[at], size[at], place[at]
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner, size, place = token[fresh], owner[fresh], size[fresh], place[fresh]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(first, len(token)))
            hot = np.repeat(many > HOT, many)
            first = first[many > HOT]
            # a hot shingle leaves a mark in its range, so that its other postings count as live
            token, owner, size, place, hot = (np.concatenate([x, y]) for x, y in zip((token, owner, size, place, hot), (token[first], owner[first], size[first], np.full(len(first), -1, np.int32), np.zeros(len(first), bool)), strict=True))
            bucket = np.where(hot, buckets + (mix(owner.view(np.uint64) ^ token) % np.uint64(buckets)).astype(np.int64), (token >> shift).astype(np.int64))
            at = np.argsort(bucket, kind="stable")
            bucket, token, owner, size, place = (x[at] for x in (bucket, token, owner, size, place))
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for low, high in zip(edge, np.append(edge[1:], len(token)), strict=True):
                yield bucket[low], *(x[low:high].tobytes() for x in (token, owner, size, place))

        def out(found) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "token", "owner", "size", "place"])

        pending = 0
        for part, data, offsets in rows(batches):
            _, _, value, word_off = words(LOWER[data], offsets, tables)
            code, stop = sets_of(value, word_off, n)
            unique, back = np.unique(value, return_inverse=True)
            at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
            rank = np.where(known[at] == unique, frequency[at], 0)[back] if len(known) else np.zeros(len(value), np.int64)
            rarest = rank.copy()
            for j in range(1, n):
                rarest[: len(rank) - j] = np.minimum(rarest[: len(rank) - j], rank[j:])
            for i in range(part.num_rows):
                low, high = word_off[i], stop[i]
                s, where = np.unique(code[low:high], return_index=True)
                if len(s) < least:
                    continue
                keep = min(len(s), len(s) - -(-percent * len(s) // 100) + LEVELS)
                key = (rarest[low:high][where].astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
                near = np.argpartition(key, keep - 1)[:keep] if keep < len(s) else np.arange(keep)
                near = near[np.argsort(key[near], kind="stable")]
                held.append((s[near], np.full(keep, _identity(s)[0], np.int64), np.full(keep, len(s), np.int32), np.arange(keep, dtype=np.int32)))
                pending += keep
            if pending > FLUSH:
                yield out(list(flush()))
                held, pending = [], 0
        if held:
            yield out(list(flush()))

    return run


def _live(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Postings of the shingles that two sets or more have in their prefixes."""
        token, owner, size, place = (np.frombuffer(b"".join(table.column(x).to_pylist()), t) for x, t in (("token", np.int64), ("owner", np.int64), ("size", np.int32), ("place", np.int32)))
        at = np.lexsort((-place, owner, token))
        token, owner, size, place = token[at], owner[at], size[at], place[at]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] < 0)
        token, owner, size, place = token[fresh], owner[fresh], size[fresh], place[fresh]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        many = np.diff(np.append(edge, len(token)))
        some = np.repeat((many > 1) | (table.column("bucket")[0].as_py() >= buckets), many) & (place >= 0)
        return pa.table({"token": token[some], "owner": owner[some], "size": size[some], "place": place[some]})

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for part, data, offsets in rows(batches):
            _, _, value, word_off = words(LOWER[data], offsets, tables)
            code, stop = sets_of(value, word_off, n)
            found = [np.unique(code[word_off[i] : stop[i]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([_identity(s)[0] for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["owner", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            good = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                inter = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                good.append(100 * inter >= percent * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


class JaccardJoin:
    """Components of documents linked by a Jaccard similarity of ``percent`` or more of n-word shingles."""

    def __init__(self, docs: DataFrame, n: int = 3, percent: int = 90) -> None:
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        shared.shared_dir(self.spark)
        shared.bounded_batches(self.spark)
        text = F.col("text").cast("string")
        self.docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        found = shared.settle(self.docs.mapInArrow(_facts(n), "key long, doc_id long, n long, a long, b long, " + ", ".join(f"{x} long" for x in [*SIGNATURE, *MINIMA])), "facts")
        self.facts = found.filter("n >= 0")
        self.words = found.filter("n < 0")
        one = [F.min("key").alias("key"), F.min("doc_id").alias("least"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in [*SIGNATURE, *MINIMA]]]
        #: one row a distinct set
        self.classes = shared.settle(self.facts.filter("n > 0").groupBy(F.col("a").alias("owner")).agg(*one), "sets-of")

    def _order(self):
        """The most frequent words and the numbers of rows that hold them: at most FREQUENT come to the driver.

        A histogram of the numbers' logarithms, a few hundred rows, gives the least number to take.
        """
        counts = shared.settle(self.words.groupBy("a").agg((-F.sum("n")).alias("df")).filter("df > 1").withColumn("step", F.floor(F.log2("df") * 16).cast("int")), "words")
        least, total = None, 0
        for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
            total += r["count"]
            if total > FREQUENT:
                break
            least = r["step"]
        top = counts.filter(F.col("step") >= F.lit(least)).select("a", "df").toArrow()
        word = top.column("a").to_numpy().view(np.uint64)
        at = np.argsort(word)
        return self.spark.sparkContext.broadcast((word[at], np.minimum(top.column("df").to_numpy()[at], (1 << 23) - 1)))

    def _postings(self) -> DataFrame:
        rows_ = self.facts.count()
        buckets = 1 << min(20, max(8, (rows_ // 2000).bit_length()))
        blobs = self.docs.mapInArrow(_postings(self.n, self.percent, buckets, self._order()), "bucket long, token binary, owner binary, size binary, place binary")
        live = shared.settle(blobs.groupBy("bucket").applyInArrow(_live(buckets), "token long, owner long, size int, place int"), "live")
        # counts are written before they are joined, here and below, so that Spark can split a hot shingle's rows
        counts = shared.settle(live.groupBy("token").agg(F.count("*").alias("df")), "counts")
        live = shared.settle(live.join(counts, "token"), "counted")
        base = F.col("size") - F.ceil(F.col("size") * self.percent / 100.0 - 1e-9)
        costs = [F.sum(F.when(F.col("place") < base + l, F.col("df") - 1).otherwise(0)).alias(f"c{l}") for l in range(1, LEVELS + 1)]
        cost = lambda l: F.col(f"c{l}") * (1 + VERIFY_COST / l)
        best = F.array_min(F.array(*[F.struct(cost(l).alias("cost"), F.lit(l).alias("level")) for l in range(1, LEVELS + 1)]))["level"]
        level = live.groupBy("owner").agg(F.min("place").alias("rarer"), *costs).select("owner", "rarer", best.alias("level"))
        level = level.join(self.classes.select("owner", *MINIMA), "owner")
        kept = live.join(level, "owner").filter(F.col("place") < base + F.col("level"))
        return shared.settle(kept.select("token", "owner", "size", "place", "rarer", F.least("level", F.col("size").cast("int")).alias("level"), "df", *MINIMA), "prefixes")

    def _links(self, pairs: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(verified links, all pairs looked at so far) of pairs (a, b) that may repeat."""
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = shared.settle(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        owners = pairs.select(F.col("a").alias("owner")).unionByName(pairs.select(F.col("b").alias("owner"))).distinct()
        own = shared.settle(self.classes.join(owners, "owner", "left_semi").select("owner", "key", F.col("n").alias("size"), *SIGNATURE), "own")
        side = lambda i, c: own.select(F.col("owner").alias(c), F.col("size").alias(f"size{i}"), *[F.col(x).alias(f"{x}_{i}") for x in SIGNATURE])
        near = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").filter(self._apart(SIGNATURE) <= self._most_apart()).select("a", "b")
        near = shared.settle(near, "near")
        owners = near.select(F.col("a").alias("owner")).unionByName(near.select(F.col("b").alias("owner"))).distinct()
        keys = own.join(owners, "owner", "left_semi").select("key")
        sets = shared.settle(self.docs.join(shared.few(keys), "key", "left_semi").select("text").mapInArrow(_sets(self.n), "owner long, shingles binary").dropDuplicates(["owner"]), "sets")
        one = near.join(sets.select(F.col("owner").alias("b"), F.col("shingles").alias("y")), "b")
        two = one.join(sets.select(F.col("owner").alias("a"), F.col("shingles").alias("x")), "a")
        checked = shared.settle(two.select("a", "b", "x", "y").mapInArrow(_verify(self.percent), "a long, b long, good boolean"), "checked")
        shared.discard(own, near, sets)
        return checked.filter("good").select("a", "b"), seen

    @staticmethod
    def _apart(columns: list[str]):
        """Bits in which two parity signatures differ; sets differ in as many shingles at least."""
        return sum((F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in columns), F.lit(0))

    def _overlap(self):
        """Shingles that two sets must share."""
        return F.ceil((F.col("size1") + F.col("size2")) * self.percent / (100.0 + self.percent) - 1e-9)

    def _most_apart(self):
        """Shingles that two linked sets may differ in."""
        return F.col("size1") + F.col("size2") - 2 * self._overlap()

    def _may_link(self):
        """Whether two sets that meet in a prefix shingle can reach the similarity there.

        Together they need an overlap of ``most`` shingles, so the shingle must lie in both prefixes of
        size - most + level, which are shorter than either set's own prefix, and sizes must be near.
        """
        p = self.percent
        low, high = F.least("size1", "size2"), F.greatest("size1", "size2")
        most = self._overlap()
        level = F.least("level1", "level2")
        inside = (F.col("place1") < F.col("size1") - most + level) & (F.col("place2") < F.col("size2") - most + level)
        return (F.col("owner1") != F.col("owner2")) & (low * 100 >= high * p) & inside

    @staticmethod
    def _pair() -> list:
        return [F.least("owner1", "owner2").alias("a"), F.greatest("owner1", "owner2").alias("b")]

    @staticmethod
    def _side(i: int, *more: str) -> list:
        return [F.col(c).alias(f"{c}{i}") for c in ("owner", "size", "place", "level", *more)]

    def _star(self, prefixes: DataFrame, *keys: str) -> DataFrame:
        """Each posting with the pivot of its ``keys``."""
        pivot = shared.settle(prefixes.groupBy(*keys).agg(F.count("*").alias("k"), F.min(F.struct("rarer", "size", "owner", "place", "level")).alias("p")).filter("k > 1"), "pivots")
        other = pivot.select(*keys, *[F.col(f"p.{c}").alias(f"{c}2") for c in ("owner", "size", "place", "level")])
        return prefixes.select(*keys, *self._side(1)).join(other, list(keys)).filter(self._may_link()).select(*self._pair())

    def _chain(self, postings: DataFrame, *keys: str) -> DataFrame:
        """Neighbours by size among the postings of one value of ``keys``; of a long list, in several chains."""
        salt = F.pmod(F.xxhash64("owner", "token"), F.ceil(F.col("df") / CHAIN).cast("long"))
        chain = Window.partitionBy(*keys, salt).orderBy("rarer", "size", "owner")
        cells = ("owner", "size", "place", "level")
        met = postings.select(*[F.col(c).alias(f"{c}1") for c in cells], *[F.lag(c).over(chain).alias(f"{c}2") for c in cells])
        return met.filter("owner2 is not null").filter(self._may_link()).select(*self._pair())

    def _between(self, postings: DataFrame, m: str) -> DataFrame:
        """For each shingle and min-hash one set of each root, any, with the one of the next root."""
        place = F.xxhash64("owner", "token", F.lit(m))
        one = postings.groupBy("token", m, "root").agg(F.min_by(F.struct("owner", "size", "place", "level"), place).alias("x"))
        chain = Window.partitionBy("token", m).orderBy(F.xxhash64("root", "token"), "root")
        cells = ("owner", "size", "place", "level")
        met = one.select(*[F.col(f"x.{c}").alias(f"{c}1") for c in cells], F.lag("x").over(chain).alias("y")).filter("y is not null")
        return met.select(*[f"{c}1" for c in cells], *[F.col(f"y.{c}").alias(f"{c}2") for c in cells]).filter(self._may_link()).select(*self._pair())

    def _open(self, prefixes: DataFrame, roots: DataFrame) -> DataFrame:
        """Postings, with their sets' roots, of the shingles in whose lists different roots are left."""
        placed = shared.settle(prefixes.join(roots, F.col("owner") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "owner")), "placed")
        more = placed.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("token")
        more = shared.settle(more, "open-tokens")
        return shared.settle(placed.join(more, "token", "left_semi"), "open")

    def _banded(self, postings: DataFrame) -> DataFrame:
        """Postings by shingle and band of sizes: each in its own band, and for its larger partners in the next.

        Sets that can link are in one band or in neighbours.  Lists without different roots go, and so do
        postings of sets that have fewer such shingles than both their own level and the list's least one.
        """
        place = F.log(F.col("size").cast("double")) / math.log(100.0 / self.percent)
        bands = F.sequence(F.floor(place - 1e-6).cast("int"), F.floor(place + 1 + 1e-6).cast("int"))
        spread = postings.withColumn("own", F.floor(place).cast("int")).withColumn("band", F.explode(bands))
        for _ in range(2):
            lists = spread.groupBy("token", "band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max(F.col("own") == F.col("band")).alias("some"), F.min("level").alias("least"))
            lists = shared.settle(lists.filter("r1 <> r2 and some").select("token", "band", "least"), "open-lists")
            left = shared.settle(spread.drop("least", "held").join(lists, ["token", "band"]), "lists")
            held = left.groupBy("owner").agg(F.count_distinct("token").alias("held"))
            spread = shared.settle(left.join(held, "owner").filter(F.col("held") >= F.least("level", "least")), "banded")
        return spread

    def _rest(self, postings: DataFrame) -> DataFrame:
        """Pairs of different roots that share as many prefix shingles as their levels ask for."""
        spread = self._banded(postings)
        folds = [F.col(SIGNATURE[i]).bitwiseXOR(F.col(SIGNATURE[i + 8])).bitwiseXOR(F.col(SIGNATURE[i + 16])).bitwiseXOR(F.col(SIGNATURE[i + 24])).alias(FOLDED[i]) for i in range(8)]
        signs = self.classes.join(spread.select("owner").distinct(), "owner", "left_semi").select("owner", *folds)
        signed_ = shared.settle(spread.join(signs, "owner"), "signed")
        cells = lambda i: [*self._side(i, "root", "held"), *[F.col(c).alias(f"{c}_{i}") for c in FOLDED]]
        x, y = signed_.select("token", "band", *cells(1)), signed_.filter("own = band").select("token", "band", *cells(2))
        once = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("owner1") < F.col("owner2")))
        need = F.least("level1", "level2")
        may = (F.col("root1") != F.col("root2")) & once & (need <= F.least("held1", "held2")) & self._may_link() & (self._apart(FOLDED) <= self._most_apart())
        met = x.join(y, ["token", "band"]).filter(may).select(*self._pair(), need.alias("need"), "token")
        return met.groupBy("a", "b").agg(F.count_distinct("token").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")

    def set_components(self) -> DataFrame:
        """node, root of the sets that link with a different set."""
        prefixes = self._postings()
        step = self._chain(prefixes, "token", MINIMA[0])
        for m in MINIMA:
            step = step.unionByName(self._star(prefixes, "token", m))
        links, seen = self._links(step, None)
        postings = self._open(prefixes, shared.settle(components(links, PARTIAL), "roots"))
        more, seen = self._links(self._between(postings, MINIMA[0]).unionByName(self._between(postings, MINIMA[1])), seen)
        links = links.unionByName(more)
        postings = self._open(postings.drop("root"), shared.settle(components(links, PARTIAL), "roots"))
        rest, _ = self._links(self._rest(postings.drop(*MINIMA)), seen)
        return shared.settle(components(links.unionByName(rest)), "roots")

    def documents(self) -> DataFrame:
        """key, doc_id, n_shingles, component (of sets; null for an empty set) and component_id of every row."""
        roots = self.set_components()
        rooted = shared.settle(self.classes.join(roots, F.col("owner") == F.col("node"), "left").select("owner", "least", F.coalesce("root", "owner").alias("component")), "rooted")
        named = shared.settle(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "named")
        classes = shared.settle(rooted.join(named, "component").select(F.col("owner").alias("set_id"), "component", "component_id"), "classes")
        out = self.facts.join(classes, F.col("a") == F.col("set_id"), "left")
        return out.select("key", "doc_id", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the first by id (rows without an id last) and hash of id and text.

    Rows without a shingle stay; rows alike in id and text are one.
    """
    found = shared.settle(JaccardJoin(docs, n, percent).documents(), "joined")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    gone = shared.settle(found.filter("component is not null").groupBy("component").agg(F.min(place)["key"].alias("first")), "firsts")
    gone = shared.settle(found.join(gone, "component").filter("key <> first").select("key").distinct(), "gone")
    key = shared.unused(docs.columns, "key")[0]
    kept = docs.withColumn(key, row_key()).join(shared.few(gone.withColumnRenamed("key", key)), key, "left_anti")
    if found.groupBy("key").count().filter("count > 1").head(1):
        kept = kept.dropDuplicates([key])
    return kept.select(*[shared.col(c) for c in docs.columns])
