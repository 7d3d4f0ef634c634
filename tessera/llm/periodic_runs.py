"""Periodic run detection: stretches of words that repeat with a period, three times or more.

Each text is searched whole by :mod:`tandem` (Lempel-Ziv blocks, suffix tree, vocabulary of squares, runs).
The first two thirds of the least run occur twice in it, so a text none of whose stretches of that many
words occurs twice has no run and needs no suffix tree.  Texts are independent: one pass over the table,
no shuffle, and memory follows the longest text.

Words are compared as they stand, never by hashes alone.  Null, blank and empty texts have no words and no
runs; rows that repeat are reported each; runs of one start are ordered by period; an empty table gives no
rows; columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tandem
from .textkernel import mix, rows

LEAST, TIMES = 24, 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_REPORT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _repeats(symbols: np.ndarray, length: int) -> bool:
    """Whether some ``length`` symbols in a row may occur twice (never False if they do)."""
    if len(symbols) <= length:
        return False
    value, have = mix(symbols.astype(np.uint64) + np.uint64(1)), 1
    while have < length:
        more = min(have, length - have)
        value = mix(value[: len(value) - more] * np.uint64(0x9E3779B97F4A7C15) + value[more:])
        have += more
    value.sort()
    return bool((value[1:] == value[:-1]).any())


def find_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` periods."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    symbols = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # a run without its last period is at least this long and occurs one period later too
    twice = -(-least * (times - 1) // times)
    return tandem.runs(symbols, least, times) if _repeats(symbols, max(1, twice)) else []


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand after the first period of a run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]


def _detect(least: int, times: int, rewrite: Callable[[list[bytes], int], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows(batches):
            raw, seeds = data.tobytes(), part.column("seed").to_pylist()
            counts, found, kept = [], [], []
            for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = raw[low:high].split()  # at the six ASCII spaces
                if rewrite is not None and seeds[i] is not None:
                    words = rewrite(words, seeds[i])
                runs = find_runs(words, least, times)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(collapse(words, runs)))
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, seed: Column | None = None, rewrite: Callable[[list[bytes], int], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> by start and period, and the collapsed text of every row.

    The collapsed text has the words outside the runs and the first period of each, joined by blanks.
    ``rewrite(words, seed)`` may change a text's words first, where ``seed``, a long, isn't null.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    return picked.mapInArrow(_detect(least, times, rewrite), _REPORT)


def highest(runs: Column) -> Column:
    """The run of the greatest length over period, compared exactly; ties go to the smaller start, then period."""

    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(more != 0, F.signum(more)).otherwise(F.signum(F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]))).cast("int")

    return F.get(F.array_sort(runs, order), 0)
