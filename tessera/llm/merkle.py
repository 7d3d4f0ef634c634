"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its break; its digest is the SHA-256 of its text.  A section ends after a
paragraph whose digest begins with one of two hexadecimal digits, so about eight paragraphs make one and an
edit moves no border but its own; its digest is that of its paragraphs' digests, and the root is that of the
sections' digests.  Equal texts have equal roots.  Where roots differ, sections that the other tree lacks, and
in them paragraphs that it lacks, locate the edit (:func:`edits`).  Likeness goes one step further down, to the
paragraphs' phrases.

All of it is SQL functions over one row's texts.  Null reads as the empty text, which has one empty paragraph;
very long texts have longer arrays, nothing else; rows that repeat have equal fingerprints; columns beyond
those named pass through in :func:`fingerprint`, and :func:`with_next` takes any names for its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: First digits of the digests that end a section.
SECTION_ENDS = ("0", "1")
#: A phrase ends after a blank or line break that follows one of these characters.
PHRASE_END = r"(?<=[.,;:!?dsy][ \n])"
#: Bits of a phrase's number that hold its length; the others hold its hash.
_LENGTH_BITS = 20
_MOST = (1 << _LENGTH_BITS) - 1


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def paragraphs(text: Column) -> Column:
    """array<string>: the lines with their breaks; joined they are the text."""
    return F.split(body(text), r"(?<=\n)")


def leaf_digests(text: Column) -> Column:
    return F.transform(paragraphs(text), _sha)


def section_strings(leaves: Column) -> Column:
    """array<string>: each section's digests of paragraphs, joined by blanks."""
    ends = F.transform(leaves, lambda d: F.concat(d, F.when(F.substring(d, 1, 1).isin(*SECTION_ENDS), "\n").otherwise(" ")))
    # the last paragraph ends a section in any case
    return F.split(F.regexp_replace(F.array_join(ends, ""), r"\s$", ""), "\n")


def root(leaves: Column) -> Column:
    return _sha(F.array_join(F.transform(section_strings(leaves), _sha), ""))


def phrases(text: Column) -> Column:
    """array<long>: hash and length of each different phrase."""
    mask = F.lit(-(1 << _LENGTH_BITS)).cast("long")
    return F.array_distinct(F.transform(F.split(body(text), PHRASE_END), lambda p: F.xxhash64(p).bitwiseAND(mask).bitwiseOR(F.least(F.length(p), F.lit(_MOST)).cast("long"))))


def weight(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, p: a + p.bitwiseAND(F.lit(_MOST).cast("long")))


def likeness(a: Column, b: Column, roots: tuple[Column, Column]) -> Column:
    """1 for equal roots; else twice the length of the phrases (columns of :func:`phrases`) in both, over the lengths of both."""
    whole = weight(a) + weight(b)
    return F.when(roots[0] == roots[1], 1.0).when(whole > 0, (2 * weight(F.array_intersect(a, b))) / whole).otherwise(0.0)


def fingerprint(docs: DataFrame, names: tuple[str, str, str] = ("fingerprint", "sections", "leaves")) -> DataFrame:
    """``docs`` with the root, the sections' strings and the paragraphs' digests of its texts."""
    taken = shared.unused(docs.columns, *names)
    top, sections, leaves = taken
    out = docs.withColumn(leaves, leaf_digests(F.col("text")))
    return out.select(*[shared.col(c) for c in docs.columns], root(F.col(leaves)).alias(top), section_strings(F.col(leaves)).alias(sections), leaves)


def edits(pairs: DataFrame, key: str) -> DataFrame:
    """key, start and length, in code points of ``text``, of each paragraph that the tree of ``other`` lacks.

    ``pairs`` has a row for each ``key`` with columns text and other.  Equal roots and, below them, equal sections
    end the search; paragraphs of the others become rows, so that a very long text is no single row's array.
    """
    name = shared.col(key)
    trees = pairs.select(name.alias("key"), F.col("text"), leaf_digests(F.col("text")).alias("mine"), leaf_digests(F.col("other")).alias("theirs"))
    trees = trees.filter(F.array_join("mine", "") != F.array_join("theirs", ""))
    trees = trees.withColumn("missing", F.array_except(section_strings(F.col("mine")), section_strings(F.col("theirs"))))
    sought = trees.select("key", F.explode(F.array_distinct(F.flatten(F.transform("missing", lambda s: F.split(s, " "))))).alias("digest"))
    known = trees.select("key", F.explode(F.array_distinct("theirs")).alias("digest"))
    gone = sought.join(known, ["key", "digest"], "left_anti")
    lines = trees.select("key", F.posexplode(F.arrays_zip(paragraphs(F.col("text")).alias("line"), F.col("mine").alias("digest"))).alias("place", "leaf"))
    w = Window.partitionBy("key").orderBy("place")
    length = F.length("leaf.line").cast("long")
    spans = lines.select("key", F.col("leaf.digest").alias("digest"), (F.sum(length).over(w) - length).alias("start"), length.alias("length"))
    return spans.join(gone, ["key", "digest"], "left_semi").select(F.col("key").alias(key), "start", "length")


def _order(docs: DataFrame) -> Column:
    """Orders rows by descending doc_id, null last; ties by text.  Smaller stands first."""
    return F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(38,0)")).alias("id"), F.xxhash64("text", F.lit(3)).alias("tie"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending doc_id, after the last the first's.

    Null ids come last, ties follow by text; rows alike in id and text are each other's next, or the
    next different row's for the last of them.  Keys alone are sorted into ranges first; then each text is
    shuffled once, to its range, where a window finds the next.  A range's first row goes to the range before it
    too, so that no border needs a join.  An empty table gives no rows; a single row follows itself.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = shared.settle(picked.select(_order(picked).alias("key")), "keys")
    parts = keys.repartitionByRange(ranges or 8 * shared.width(spark), "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"))
    firsts = sorted((r["first"] for r in parts.collect()), key=lambda k: (k["none"], k["id"] if k["id"] is not None else 0, k["tie"]))
    shared.discard(keys)
    if not firsts:
        return picked.withColumn("next_text", F.lit(None).cast("string"))
    kind = keys.schema["key"].dataType
    number = len(firsts)
    bounds = F.from_json(F.lit("[" + ",".join(_json(k) for k in firsts) + "]"), f"array<{kind.simpleString()}>")
    # the last range whose first key isn't after the row's, by halving
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(number.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < number) & (F.get(bounds, at + s) <= F.col("key")), at + s).otherwise(at))
    placed = picked.withColumn("key", _order(picked)).withColumn("place", place)
    first = F.get(bounds, F.col("place")) == F.col("key")
    own = F.struct(F.col("place").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("place") - 1, F.lit(number)).alias("at"), F.lit(True).alias("guest"))
    sent = placed.select("doc_id", "text", "key", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy("at").orderBy("guest", "key")
    return sent.withColumn("next_text", F.lead("text").over(w)).filter(~F.col("guest")).select("doc_id", "text", "next_text")


def _json(key) -> str:
    number = "null" if key["id"] is None else str(key["id"])
    return f'{{"none":{str(key["none"]).lower()},"id":{number},"tie":{key["tie"]}}}'


def edited(text: Column, other: Column) -> Column:
    """``text`` whose last half, rounded down, gives way to as much of ``other``'s begin, or to all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
