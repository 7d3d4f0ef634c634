"""Quality rules: cross-document line frequency.

Every line is normalised (ASCII lower case, digits to 0, white space collapsed) and hashed.  For
each host the number of distinct documents holding a line is counted (``by_text``: of distinct texts,
where a text copied to a large part of a host should not turn into boilerplate).  Lines held by
more than ``max(min_docs, share * documents of the host)`` documents are removed, and a document is
rejected if removal leaves less than ``min_left`` of its words.  The share decides at every size;
``min_docs`` only keeps a few documents that agree by chance in a small host from being boilerplate.

Defined cases: null text reads as empty; a null host is a host of its own; rows alike in id, host and
text are one document and get the same verdict; a line held by just as many documents as the limit
stays; texts are read whole, however long; an empty table gives an empty result; columns beyond those
named pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textkernel import SPACE, Tables, mix, rows, words

FEW_DOCS = 3
SHARE = 0.01
MIN_LEFT = 0.4

_FOLD = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STATS = "doc_key long, host string, doc_id long, body long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"


def line_hash(line: bytes) -> tuple[int, int]:
    """(hash, words) of a line after normalisation."""
    parts = line.translate(_FOLD).split()
    return xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63), len(parts)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(value: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """Words of each row inside three-word windows that the row has at least twice."""
    n = len(value)
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        row = np.repeat(np.arange(len(word_off) - 1, dtype=np.uint64), np.diff(word_off))
        key = mix(value[:-2] + mix(value[1:-1] + mix(value[2:] + mix(row[:-2]))))
        same = row[2:] == row[:-2]
        ordered = np.sort(key[same])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = np.flatnonzero(same & (twice[at] == key))
            for shift in range(3):
                covered[hit + shift] = True
    return _per_row(covered, word_off)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = Tables()
    for part, data, offsets in rows(batches):
        _, _, value, word_off = words(data, offsets, tables)
        dup, lines = [], []
        raw = data.tobytes()
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = [x for x in raw[low:high].split(b"\n") if x.strip()]
            dup.append(len(found) - len(set(found)))
            total: dict[int, int] = {}
            for x in found:
                code, size = line_hash(x)
                total[code] = total.get(code, 0) + size
            lines.append([{"line": k, "words": v} for k, v in total.items()])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_key"), part.column("host"), part.column("doc_id"), part.column("body"),
                pa.array(np.diff(word_off)),
                pa.array(_per_row((~SPACE[data]) & ((data & 0xC0) != 0x80), offsets)),
                pa.array(_per_row(_SYMBOL[data], offsets)),
                pa.array(dup, pa.int64()),
                pa.array(repeated_words(value, word_off)),
                pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))),
            ],
            ["doc_key", "host", "doc_id", "body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def _keyed(docs: DataFrame, host: str) -> list:
    """The columns that name a row: rows alike in id, host and text share a key and a verdict."""
    return [
        F.xxhash64(F.col("doc_id"), F.col(host), F.col("text")).alias("doc_key"),
        F.col(host).cast("string").alias("host"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(7)).alias("body"),
        F.col("text"),
    ]


def line_report(docs: DataFrame, host: str = "source", min_docs: int = FEW_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, by_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: its counts, the hashes of its lines to remove and the verdict.

    Columns: doc_key, host, doc_id, the five counts, bad_lines array<long>, removed_words, depleted.
    The lines are counted with map-side sums and meet the frequent ones in a shuffled join, whose
    hot keys Spark may split: the frequent side has one row a key.
    """
    shared.bounded_batches(docs.sparkSession)
    stats = shared.settle(docs.select(*_keyed(docs, host)).mapInArrow(_scan, _STATS), "line-stats")
    spread = stats.select("doc_key", "host", "body", F.inline("lines"))
    unit = "body" if by_text else "doc_key"
    place = F.xxhash64(F.col("host"), F.col("line"))
    counted = spread.groupBy("host", "line").agg(F.count_distinct(unit).alias("docs")).filter(F.col("docs") > min_docs)
    hosts = stats.groupBy("host").agg(F.count_distinct(unit).alias("host_docs"))
    frequent = (
        counted.join(hosts, counted["host"].eqNullSafe(hosts["host"]))
        .filter(F.col("docs") > F.col("host_docs") * share)
        .select(place_of(counted).alias("place"))
    )
    bad = (
        spread.select("doc_key", place.alias("place"), "line", "words")
        .join(frequent, "place")
        .groupBy("doc_key")
        .agg(F.collect_set(F.struct("line", "words")).alias("bad"))
    )
    removed = F.coalesce(F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    return (
        stats.drop("lines")
        .join(bad, "doc_key", "left")
        .withColumn("removed_words", removed)
        .withColumn("bad_lines", F.coalesce(F.transform("bad", lambda x: x["line"]), F.array().cast("array<long>")))
        .withColumn("depleted", (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < F.col("n_words") * min_left))
        .drop("bad")
    )


def place_of(df: DataFrame):
    return F.xxhash64(df["host"], df["line"])


def base_failed():
    """The base rules: too short, or mostly repeating itself."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the lines that the last column lists out of the text."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        bad = batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column(at).to_pylist()
        for i, drop in enumerate(bad):
            if drop and texts[i] is not None:
                gone = set(drop)
                texts[i] = b"\n".join(x for x in texts[i].encode().split(b"\n") if not x.strip() or line_hash(x)[0] not in gone).decode()
        columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``docs`` without rejected rows, the others' frequent lines removed from ``text``; columns pass through whatever their names."""
    report = line_report(docs, host, **limits)
    key, reject, bad = shared.unused(docs.columns, "key", "reject", "bad_lines")
    verdict = report.filter(base_failed() | F.col("depleted") | (F.size("bad_lines") > 0)).groupBy(F.col("doc_key").alias(key)).agg(
        F.max(base_failed() | F.col("depleted")).alias(reject), F.first("bad_lines").alias(bad)
    )
    joined = docs.withColumn(key, _keyed(docs, host)[0]).join(verdict.hint("shuffle_hash"), key, "left")
    kept = joined.filter(~F.coalesce(F.col(reject), F.lit(False))).select(*[shared.col(c) for c in docs.columns], bad)
    return kept.mapInArrow(_strip, kept.schema).drop(bad)
