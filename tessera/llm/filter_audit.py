"""Filter interaction audit by a Walsh-Hadamard transform.

Each document fails some of five filters, which makes a mask of five bits.  For every part and every class of
labels 32 signed sums are counted: for each set of filters the documents that fail an even number of them less those
that fail an odd number.  That is all that is aggregated, in one shuffle with map-side sums.  The inverse transform
gives the exact number of documents with each mask; whatever a filter removes in any order, and its Shapley
share (120 orders over the number of filters that a document fails, for each document that fails it), follows from
those 32 numbers.

Null text reads as empty, a null part as the empty string; documents with one id are told apart by nothing but
their text, so rows that repeat don't fail as copies of each other, and null ids come after all others; a
document whose labels disagree has both, one without an id none; very long texts are taken whole; an empty table gives no parts; only the
columns named are read, whatever others are called.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .merkle import body

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = tuple("".join(x) for x in permutations(LETTERS))


def failures(text: Column) -> Column:
    """The bits of the filters that look at one text: length, vocabulary, capitals, signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))

    def bits(c: Column) -> Column:
        fails = (c["n"] < 50, 100 * c["different"] < 65 * c["n"], 100 * capitals.cast("long") > 5 * F.length(text), text.rlike("[#$%&*|]"))
        return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(counted), bits), 0)


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, good, toxic and mask of every document; the fifth bit is that a smaller id has the same text."""
    text = body(F.col("text"))
    seen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(shared.col(part).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.sha2(text.cast("binary"), 256).alias("digest")
    )
    seen = shared.settle(seen, "failures")
    # texts that stand once need no partner; of the others one row each is joined, so hot texts can be split
    copied = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1").select("digest", "least")
    copied = shared.settle(copied, "copied")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    later = F.coalesce((F.col("doc_id") > F.col("least")) | (F.col("doc_id").isNull() & F.col("least").isNotNull()), F.lit(False))
    rows = seen.join(copied, "digest", "left").join(known, "doc_id", "left")
    return rows.select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def parity_sums(seen: DataFrame) -> DataFrame:
    """part, good, toxic and ``sums``: for each of 32 sets of filters the signed sum over the documents."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    found = seen.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(MASKS)])
    return found.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """The inverse transform: the number of documents with each mask, exactly."""
    places = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def cell(mask: Column) -> Column:
        signed = F.zip_with(sums, places, lambda s, i: s * (1 - 2 * (F.bit_count(i.bitwiseAND(mask)) % 2)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x), len(LETTERS))

    return F.transform(places, cell)


def _steps() -> list[dict]:
    """Each order's steps: the filter, and the sets of filters before and after it."""
    out = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            at = LETTERS.index(letter)
            out.append({"filter_order": order, "step": k + 1, "filter": at, "before": before, "now": before | 1 << at})
            before |= 1 << at
    return out


def _where(column: str, test) -> Column:
    """Sum of the cells whose mask passes ``test(mask)``."""
    picked = F.filter(F.transform(F.col(column), lambda n, m: F.when(test(m), n)), lambda n: n.isNotNull())
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, n: a + n)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    sums = parity_sums(masks(docs, labels, part))
    by = sums.select("part", "good", "toxic", cells(F.col("sums")).alias("n"))
    total = lambda when: F.array(*[F.sum(F.when(when, F.get("n", F.lit(m))).otherwise(0)) for m in range(MASKS)])
    parts = by.groupBy("part").agg(total(F.lit(True)).alias("all"), total(F.col("good") == 1).alias("good"), total(F.col("toxic") == 1).alias("toxic"))
    # what is left after each set of filters, and what depends on one filter alone
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    left = lambda c: F.transform(every, lambda s: _where(c, lambda m: m.bitwiseAND(s) == 0))
    single = F.array(*[F.lit(1 << f) for f in range(len(LETTERS))])
    has = lambda m, f: m.bitwiseAND(f) != 0
    share = lambda f: F.aggregate(F.transform("all", lambda n, m: F.when(has(m, f), n * (120 / F.bit_count(m)).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    own = F.transform(single, lambda f: F.struct(_where("all", lambda m: has(m, f)).alias("fails"), F.get("all", f).alias("unique"), share(f).alias("shapley")))
    tables = parts.select("part", left("all").alias("left_all"), left("good").alias("left_good"), left("toxic").alias("left_toxic"), own.alias("own"))
    spread = tables.select("*", F.inline(F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,filter:int,before:int,now:int>>")))
    lost = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("now"))
    mine = F.get("own", F.col("filter"))
    return spread.select(
        "part", "filter_order", "step", F.get("left_all", F.col("now")).alias("kept"), lost("all").alias("removed"), (mine["fails"] - lost("all")).alias("redundant"),
        mine["unique"].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), mine["shapley"].alias("shapley"),
    )
