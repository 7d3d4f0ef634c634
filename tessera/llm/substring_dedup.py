"""Substring deduplication by suffix automata of reference shards.

A word goes if it lies in a window of ``window`` words whose sequence of words starts at another place
of the corpus too, the same text included.

1. Each window is named by the least hash of its runs of ``GRAM`` words; equal windows have equal
   names.  Windows in a row with one name form a segment.  Names are counted over the whole corpus,
   and segments whose name occurs once can hold no repeated window.
2. Segments that are left are the reference.  Equal ones collapse to one with a count (all of such a
   segment is repeated).  Names with different segments are dealt to reference shards of bounded
   size; equal windows meet in one shard.
3. In a shard a suffix automaton is built over the segments, and matching statistics give for each
   word the longest sequence ending there that occurs twice.  Where it reaches the window's length,
   the words are marked.  A name with more than ``MOST_WORDS`` words is cut into blocks; for each pair
   of blocks a task of its own streams the segments of one against the automaton of the other.
4. Marks go back to the segments' documents, and maximal spans are cut out.

An automaton over the whole corpus can't be broadcast within a bound, so shards go to the segments
that can match them rather than to every task.  Words are compared by 64-bit hashes.

Null text has no words and stays null; rows that repeat are copies of each other; texts shorter than a
window are kept; texts are read whole, in bounded pieces, however long; ties don't arise, as every
occurrence is cut; an empty table gives no rows; columns beyond those named pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import shared
from .automaton import SuffixAutomaton
from .textkernel import Tables, mix, rows, signed, words

WINDOW = 35
GRAM = 8
SHARD_WORDS = 50_000
MOST_WORDS = 200_000
BOTH, REFERENCE, STREAMED = 0, 1, 2
_SEGMENT = "name long, seg long, row_key long, start int, windows int, places int"
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def row_key():
    """Rows alike in id and text share a key, and so their marks."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(value: np.ndarray, word_off: np.ndarray, tables: Tables, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(row, start, windows, name, content hash, places of the naming run) of each segment of a batch."""
    total = len(value)
    if total < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    gram = np.zeros(total - GRAM + 1, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * _MULTIPLIER + value[j : j + len(gram)]
    gram = mix(gram)
    name = _sliding_min(gram, window - GRAM + 1)
    row = np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))
    whole = row[: len(name)] == row[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return segments(value[:0], word_off[:1], tables, window)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (name[at[1:]] != name[at[:-1]]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    name = name[start]
    tables.grow(total)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(value * tables.up[:total], out=sums[1:])
    content = mix(mix((sums[start + count - 1 + window] - sums[start]) * tables.down[start]) + count.astype(np.uint64))
    span = count + window - GRAM
    ends = np.cumsum(span)
    inner = np.arange(ends[-1]) + np.repeat(start - (ends - span), span)
    places = np.add.reduceat((gram[inner] == np.repeat(name, span)).astype(np.int64), ends - span)
    return row[start], start - word_off[row[start]], count, name, content, places


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for part, data, offsets in rows(batches, most=2 << 20):
            _, _, value, word_off = words(data, offsets, tables)
            row, start, count, name, content, places = segments(value, word_off, tables, window)
            key = part.column("row_key").to_numpy()[row] if len(row) else row
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(name)), pa.array(signed(content)), pa.array(key, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, count, places))],
                ["name", "seg", "row_key", "start", "windows", "places"],
            )

    return run


def _fetch(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for part, data, offsets in rows(batches):
            _, _, value, word_off = words(data, offsets, tables)
            out: list[tuple] = []
            for i, wanted in enumerate(part.column(part.schema.get_field_index("wanted")).to_pylist()):
                for x in wanted:
                    low = word_off[i] + x["start"]
                    out.append((x["shard"], x["role"], x["name"], x["seg"], x["copies"], value[low : low + x["windows"] + window - 1].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "role", "name", "seg", "copies", "words"])

    return run


def _runs(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal ranges of words covered by matches of at least ``window`` words."""
    out: list[list[int]] = []
    for i, n in enumerate(lengths):
        if n >= window:
            if out and i - n + 1 <= out[-1][1]:
                out[-1] = [min(out[-1][0], i - n + 1), i + 1]
            else:
                out.append([i - n + 1, i + 1])
    return [(a, b) for a, b in out]


def match(found: list[tuple[list[int], int, int]], window: int) -> list[list[tuple[int, int]]]:
    """Covered ranges of each (sequence, copies, role): references get an automaton, in which their own
    repetitions are looked up; the sequences that are only streamed get matching statistics against it."""
    automaton = SuffixAutomaton()
    states = {i: automaton.add(seq, copies) for i, (seq, copies, role) in enumerate(found) if role != STREAMED}
    automaton.settle()
    return [
        _runs(automaton.matches(seq) if role == STREAMED else automaton.repeated(states[i]), window) if role != REFERENCE else []
        for i, (seq, _, role) in enumerate(found)
    ]


def _shard(window: int):
    schema = pa.schema([("name", pa.int64()), ("seg", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        unique: dict[tuple[int, int, int], tuple[int, bytes]] = {}
        for name, seg, role, copies, content in zip(*(table.column(x).to_pylist() for x in ("name", "seg", "role", "copies", "words")), strict=True):
            unique[name, seg, role] = (copies, content)
        keys = sorted(unique)
        sizes = [len(unique[k][1]) // 8 for k in keys]
        _, code = np.unique(np.frombuffer(b"".join(unique[k][1] for k in keys), np.uint64), return_inverse=True)
        ends = np.cumsum(sizes)
        found = [(code[e - n : e].tolist(), unique[k][0], k[2]) for k, n, e in zip(keys, sizes, ends, strict=True)]
        out = [(k[0], k[1], a, b) for k, ranges in zip(keys, match(found, window), strict=True) for a, b in ranges]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def _dealt(mixed: DataFrame, window: int, most: int) -> DataFrame:
    """``mixed`` with the shards (shard, role) of each segment: one, or for names of more than ``most`` words two
    for every block of the name: as a reference for that block's segments, and to be streamed against its automaton."""
    total = mixed.agg(F.sum(F.col("one.windows") + window)).first()[0] or 0
    shards = max(64, -(-total // SHARD_WORDS))
    size = mixed.groupBy("name").agg(F.sum(F.col("one.windows") + window).alias("size")).filter(F.col("size") > most)
    large = shared.settle(size.select("name", F.ceil(F.col("size") / most).cast("int").alias("blocks")), "large-names")
    sole = mixed.join(large, "name", "left_anti").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))).withColumn("role", F.lit(BOTH))
    cut = mixed.join(large, "name").withColumn("own", F.pmod(F.xxhash64("seg", F.lit(9)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = lambda i, j, role: F.struct((F.xxhash64("name", F.lit(17), i, j).bitwiseOR(F.lit(-(1 << 63)))).alias("shard"), role.alias("role"))
    own, other = F.col("own"), F.col("other")
    here = cell(own, other, F.when(own == other, BOTH).otherwise(REFERENCE))
    there = cell(other, own, F.lit(STREAMED))
    cut = cut.withColumn("x", F.explode(F.when(own == other, F.array(here)).otherwise(F.array(here, there)))).select(*mixed.columns, "x.shard", "x.role")
    return sole.unionByName(cut)


def repeated_spans(docs: DataFrame, window: int = WINDOW, most: int = MOST_WORDS) -> DataFrame:
    """row_key, spans array<struct<low, high>> (word ranges, may overlap) of rows with repeated windows."""
    spark = docs.sparkSession
    shared.shared_dir(spark)
    shared.bounded_batches(spark)
    keyed = docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    scanned = shared.settle(keyed.mapInArrow(_scan(window), _SEGMENT), "scanned")
    # names are written before they are joined, here and below, so that Spark can split a hot name's rows
    repeated = shared.settle(scanned.groupBy("name").agg(F.sum("places").alias("n")).filter("n > 1").select("name"), "repeated")
    found = shared.settle(scanned.drop("places").join(repeated, "name"), "segments")
    distinct = found.groupBy("name", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "start", "windows")).alias("one"))
    distinct = shared.settle(distinct, "distinct")
    # a name needs an automaton unless all its segments are copies of one
    mixed = distinct.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).filter("kinds > 1 or all = 1").select("name")
    mixed = shared.settle(mixed, "mixed")
    mixed = shared.settle(distinct.join(mixed, "name"), "reference")
    shared.discard(scanned)
    wanted = (
        _dealt(mixed, window, most)
        .select(F.col("one.row_key").alias("row_key"), F.struct("shard", "role", "name", "seg", "copies", "one.start", "one.windows").alias("x"))
        .groupBy("row_key")
        .agg(F.collect_list("x").alias("wanted"))
    )
    content = keyed.join(wanted.hint("shuffle_hash"), "row_key").select("text", "wanted").mapInArrow(_fetch(window), "shard long, role int, name long, seg long, copies long, words binary")
    partial = content.groupBy("shard").applyInArrow(_shard(window), "name long, seg long, low int, high int")
    whole = distinct.filter("copies > 1").select("name", "seg", F.lit(0).alias("low"), (F.col("one.windows") + window - 1).alias("high"))
    cover = shared.settle(partial.join(whole.select("name", "seg"), ["name", "seg"], "left_anti").unionByName(whole), "cover")
    spans = found.join(cover, ["name", "seg"]).select("row_key", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("span"))
    return spans.groupBy("row_key").agg(F.collect_set("span").alias("spans"))


def _cut(passed: list[str]):
    """The columns ``passed`` with the text cut, and the counts and digest; the last column has the row's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for part, data, offsets in rows(batches):
            start, end, _, word_off = words(data, offsets, tables)
            spans = part.column(part.num_columns - 1).to_pylist()
            raw = data.tobytes()
            texts, sizes, gone, digest = part.column(part.schema.get_field_index("text")).to_pylist(), [], [], []
            for i in range(part.num_rows):
                low, high = int(word_off[i]), int(word_off[i + 1])
                text = raw[offsets[i] : offsets[i + 1]]
                sizes.append(high - low)
                if not spans[i]:
                    gone.append(0)
                    digest.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    continue
                marks = np.zeros(high - low + 1, dtype=np.int64)
                np.add.at(marks, [s["low"] for s in spans[i]], 1)
                np.add.at(marks, [s["high"] for s in spans[i]], -1)
                out = np.cumsum(marks[:-1]) > 0
                gone.append(int(out.sum()))
                kept = np.flatnonzero(~out) + low
                digest.append(hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(start[kept].tolist(), end[kept].tolist(), strict=True))).hexdigest())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                pieces, at = [], int(offsets[i])
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    pieces.append(raw[at : start[low + a]])
                    at = int(end[low + b - 1])
                texts[i] = b"".join([*pieces, raw[at : offsets[i + 1]]]).decode()
            at = {f.name: i for i, f in enumerate(part.schema)}
            columns = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(at[c]) for c in passed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], [*passed, "n", "gone", "digest"])

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, with_text: bool = True, most: int = MOST_WORDS, names: tuple[str, ...] = ("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """``docs`` with repeated windows' words cut out of ``text``, and the columns ``names``: words, removed words and digest.

    The digest is that of the kept words joined by one blank.  Without ``with_text`` the text is left out.
    Columns of ``docs`` that have one of the ``names``, in whatever case, are replaced, all others pass through.
    """
    key, own = shared.unused(docs.columns, "row_key", "spans")
    spans = repeated_spans(docs, window, most).select(F.col("row_key").alias(key), F.col("spans").alias(own))
    joined = docs.withColumn(key, row_key()).join(spans.hint("shuffle_hash"), key, "left")
    # plain names inside, as PySpark can't hand every name to a worker
    plain = {f"c{i}" if f.name != "text" else "text": f for i, f in enumerate(docs.schema.fields)}
    kept = {p: f for p, f in plain.items() if f.name.lower() not in {n.lower() for n in names} and (with_text or p != "text")}
    kinds = StructType([*(StructField(p, f.dataType) for p, f in kept.items()), StructField("n", LongType()), StructField("gone", LongType()), StructField("digest", StringType())])
    sent = joined.select(*[shared.col(f.name).alias(p) for p, f in plain.items()], F.col(key).alias("key"), F.col(own).alias("spans"))
    return sent.mapInArrow(_cut(list(kept)), kinds).toDF(*(f.name for f in kept.values()), *names)
