"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

1. quality rules: documents that fail the base rules or are mostly boilerplate lines go; boilerplate
   lines are cut from the others;
2. near copies: of each group linked by a Jaccard similarity of 0.8 on five-word shingles one document
   stays, the one with the smallest id;
3. repeated passages: words inside windows of 35 words that occur elsewhere too are cut; a document of
   which nothing is left goes;
4. mixing: documents are repeated at random so that sources weigh the square root of their sizes;
5. packing into windows of 4096 tokens.

Null or empty texts fail the base rules, so they go first; texts are read whole, however long.  Ties
(near copies with one id) go to the smaller hash of id and text; rows alike in id and text are one after
stage 2 and copies of each other before.  Extra columns, whatever their names, pass through the first
four stages; nulls in them, in lang or in source change nothing (a null source is a source of its own),
a null doc_id comes after all others.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, line_frequency, mixing, packing, shared, substring_dedup


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``; n_chars follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[shared.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by distinct texts: copies go in the next stage, and a text copied often must not become boilerplate here
    return _counted(line_frequency.clean_documents(docs, by_text=True), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, gone, digest = shared.unused(docs.columns, "n_words", "n_removed", "kept_sha256")
    cut = substring_dedup.remove_repeated(docs, names=(words, gone, digest))
    return _counted(cut.filter((F.col(gone) == 0) | (F.col(gone) < F.col(words))), docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(shared.unused(docs.columns, "copies", "copy", "shuffle_key"))
    mixed = mixing.replicate(docs, mixing.rates(docs), names=names)
    return mixed.select(*[shared.col(c) for c in docs.columns])


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: The stages hash, link and cut in ways that SQL doesn't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared.fresh_path(spark, name)
        with shared.scratch(spark):  # what the stage wrote on its way goes
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            shared.drop_path(spark, before)
        before = path
    return docs
