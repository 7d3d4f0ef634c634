"""Pluggable embedders and language models; the shipped ones are deterministic and local."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexical import parse_terms

BATCH = 64
Embed = Callable[[list[str]], list[list[float]]]
Complete = Callable[[str, str], str]


def hash_embedder(dim: int = 64) -> Embed:
    """Signed feature hashing of terms, scaled to unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for term in parse_terms(text, max_terms=10_000) or [text or " "]:
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v] if any(v) else [1.0 / math.sqrt(dim)] * dim)
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Embed, key: str = "entity_id", text: str = "chunk") -> DataFrame:
    """``key`` and embedding of every chunk; an embedder that returns another number of vectors, or an empty one, fails."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(key), batch.column(text).to_pylist()
            out: list[list[float]] = []
            for low in range(0, len(texts), BATCH):
                part = texts[low : low + BATCH]
                found = embed(part)
                if len(found) != len(part) or any(not v for v in found):
                    raise ValueError("the embedder must return one vector a text")
                out += found
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], [key, "embedding"])

    return chunks.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def rewrite_query(query: str, complete: Complete | None) -> str:
    """A query with CJK characters as the model rewrites it; the query itself without a model, on failure or blank."""
    text = query.strip()
    if complete is None or not any("㐀" <= c <= "鿿" for c in text):
        return text
    try:
        return " ".join(complete("Rewrite the question as a short English code search query.", text).split()) or text
    except Exception:  # the original is always a valid query
        return text


def embed_with_cache(chunks: DataFrame, embed: Embed, store, model: str = "default", key: str = "entity_id", text: str = "chunk") -> DataFrame:
    """``key`` and embedding of every chunk, texts embedded before by ``model`` from the store's cache.

    Only texts that the cache lacks, each once, go to the embedder; they are added to the cache before
    anything is returned, so a run that fails later doesn't pay for them again.
    """
    name = f"embeddings-{model}"
    keyed = chunks.select(key, text, F.sha2(F.col(text), 256).alias("text_hash"))
    wanted = keyed.groupBy("text_hash").agg(F.any_value(text).alias(text))
    if store.has(name):
        wanted = wanted.join(store.read(name, "cache").select("text_hash"), "text_hash", "left_anti")
    missing = store.settle(wanted)
    if missing.head(1):
        store.publish(name, {}, keep=True, more={"cache": embed_chunks(missing, embed, "text_hash", text)})
    store.unsettle(missing)
    return keyed.join(store.read(name, "cache").dropDuplicates(["text_hash"]), "text_hash").select(key, "embedding")


def cached(table: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(known, missing) of ``wanted`` keys in a cache table."""
    return wanted.join(table, key), wanted.join(table.select(F.col(key)), key, "left_anti")
