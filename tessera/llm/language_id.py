"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and every other character reads as a gap, so a text is a row of letters and
single gaps.  Its n-grams of 1 to 3 code points are hashed into ``2**bits`` buckets.  Learning sums
bucket counts by language over a bounded sample (``max_docs`` documents a language, those with the
smallest hashes of their ids, whole texts); the matrix of log probabilities, whose size depends only
on ``bits`` and the number of languages, is broadcast, and texts are scored in numpy in sparse
batches of distinct (text, bucket) counts.

Defined cases: null text, or text without a letter, gives ``und`` and score 0, as does every text if
nothing could be learned; ties go to the alphabetically first language; rows that repeat are
predicted each; texts are scored whole, however long; columns beyond doc_id, text and lang are not
read, and kept ones pass through (lang_pred and score are added); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textkernel import mix

BITS = 16
MAX_DOCS = 4000
MAX_LANGS = 512
ORDERS = (1, 2, 3)


def _letters() -> np.ndarray:
    """Lower case of every code point up to U+FFFF, 32 for what is no letter."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Buckets:
    """Hashed n-grams of texts."""

    def __init__(self, bits: int) -> None:
        self.bits, self.table = bits, _letters()

    def of(self, text: str) -> np.ndarray:
        """Bucket of every n-gram; empty if there is no letter."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        plain = np.minimum(code, 0xFFFF)
        code = self.table[plain]
        high = plain == 0xFFFF
        if high.any():
            code[high] = [ord(c) if (c := text[i]).isalpha() else 32 for i in np.flatnonzero(high)]
        gap = code == 32
        if gap.all():
            return np.empty(0, np.int64)
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        code = code[keep]
        code = np.concatenate([[32], code[:-1] if code[-1] == 32 else code, [32]]).astype(np.uint64)
        out = []
        for n in ORDERS:
            value = np.full(max(len(code) - n + 1, 0), n, dtype=np.uint64)
            for i in range(n):
                value = value * np.uint64(0x1FFFFF) + code[i : i + len(value)]
            out.append(mix(value) >> np.uint64(64 - self.bits))
        return np.concatenate(out).astype(np.int64)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, sums = Buckets(bits), {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text:
                    mine = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    mine += np.bincount(buckets.of(text), minlength=1 << bits)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], ["lang", "bucket", "n"])

    return run


def fit(train: DataFrame, bits: int = BITS, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their matrix of log probabilities (buckets x languages, with add-one smoothing).

    At most ``max_docs`` documents of each language are used, by a threshold on the hash of their ids;
    all languages weigh alike.  More than ``MAX_LANGS`` languages, whose matrix would outgrow the
    driver, are an error: none is left out.
    """
    shared.shared_dir(train.sparkSession)
    known = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    if not sizes:
        return [], np.zeros((1 << bits, 0), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(luck < F.element_at(share, F.col("lang"))).select("lang", "text")
    found = sample.mapInArrow(_count(bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted({x for x in found.column("lang").to_pylist()})
    counts = np.zeros((1 << bits, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    counts[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    counts += 1
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _score(model, langs: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, logp = Buckets(bits), model.value
        names = [*langs, "und"]
        for b in batches:
            best, score = np.full(b.num_rows, len(langs)), np.zeros(b.num_rows)
            texts = b.column(b.num_columns - 1)
            for low in range(0, b.num_rows, 64):
                found = [buckets.of(texts[i].as_py() or "") for i in range(low, min(low + 64, b.num_rows))]
                size = np.array([len(x) for x in found])
                if not size.any() or not langs:
                    continue
                # one sparse row a text: its distinct buckets and their counts
                key = np.concatenate([x + (i << bits) for i, x in enumerate(found)])
                cells = np.bincount(key, minlength=len(found) << bits)
                key = np.flatnonzero(cells)
                weight = cells[key].astype(np.float64)
                row = key >> bits
                rows = np.flatnonzero(size)
                begin = np.searchsorted(row, rows)
                total = np.add.reduceat(logp[key & ((1 << bits) - 1)] * weight[:, None], begin, axis=0)
                top = total.argmax(axis=1)
                best[low + rows] = top
                score[low + rows] = 1 / np.exp(total - total[np.arange(len(rows)), top][:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([names[i] for i in best], pa.string()), pa.array(score)], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: list[Column]) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with lang_pred and score; reads only them and text."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    bits = int(logp.shape[0]).bit_length() - 1
    rows = docs.select(*keep, F.col("text").cast("string").alias(shared.unused(docs.select(*keep).columns, "text")[0]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    model = spark.sparkContext.broadcast(logp)
    return rows.mapInArrow(_score(model, langs, bits), f"{kinds}, lang_pred string, score double")
