import hashlib

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_operators import SCHEMA, corpus

COLUMNS = SCHEMA.replace(", row_key string, n string, host string", "")


def test_stages_take_effect(spark, tmp_path):
    rows = [x[:5] for x in corpus(seed=8, n=160)]
    docs = spark.createDataFrame(rows, COLUMNS)
    by = dict(corpus_pipeline.STAGES)
    kept = by["quality_rules"](spark, docs, "")
    assert kept.columns == docs.columns
    good = {i for i, t, *_ in rows if not brute.base_counts(t)[5]}
    first = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in first} == good and all(r[4] == len(r[1]) for r in first)
    second = by["near_copies"](spark, kept, "").collect()
    linked = brute.components([(r[0], r[1]) for r in first], 5, 80)
    assert {r.doc_id for r in second} == {c for _, c in linked.values()}
    third = by["repeated_passages"](spark, spark.createDataFrame(second, COLUMNS), "").collect()
    want = dict(zip([r.doc_id for r in second], brute.removed_windows([r.text for r in second]), strict=True))
    assert {r.doc_id for r in third} == {i for i, (n, gone, _) in want.items() if gone < n}
    assert all(hashlib.sha256(" ".join(brute.WORD.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2] for r in third)
    mixed = by["source_mixing"](spark, spark.createDataFrame(third, COLUMNS), "")
    assert mixed.columns == docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed.collect()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [x.split()[0] for x in COLUMNS.split(", ")] and docs.count() == 0
