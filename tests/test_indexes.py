import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import queries, testdata
from tessera.operators import adjacency, graph, search, term_index, vector_index

SCHEMA = "entity_id long, entity_type string, name string, qualified_name string, file_path string, start_line int, end_line int, content string, metadata_json string"


def some_entities(n=300):
    r = random.Random(12)
    word = lambda: r.choice(("order", "Controller", "find", "Straße", "café", "ΣΑΣ", "😀x", "/api/v2", "%_$", "a", "İd", "the", "code"))
    rows = []
    for i in range(n):
        name = word() + word()
        text = " ".join(word() for _ in range(r.randint(0, 30)))
        rows.append((i * 7 - 500, r.choice("xy"), name, f"pkg.{word()}.{name}", f"src/{word()}/{i}.py", 1, 2, r.choice((text, text, None)), r.choice(('{"path": "/api/v2"}', None, "{}"))))
    return rows


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    table = spark.createDataFrame(some_entities(), SCHEMA).repartition(3)
    folder = str(tmp_path_factory.mktemp("terms"))
    term_index.build(table, f"{folder}/rows", f"{folder}/postings")
    return table, term_index.TermIndex.at(spark, folder)


def found(df):
    return [(r.entity_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("query", ["order", "findorder", "STRASSE", "café", "σας", "😀", "a", "%", "/api/v2", "order the code", "pkg.find.thecode", "nowhere.order", "i̇d find", "xyzzy", "the", "\\", "$"])
def test_index_finds_what_a_scan_finds(indexed, query):
    table, index = indexed
    assert found(index.search(query, 15)) == found(search.keyword_search(table, query, 15))


def test_index_with_filter_limits_and_columns(indexed):
    table, index = indexed
    some = F.col("entity_type") == "x"
    assert found(index.top(["order", "find"], 400, where=some)) == found(search.lexical_top(table.filter(some), ["order", "find"], 400))
    assert index.search("order", 3).columns == [*table.columns, "score"]
    assert index.top(["order"], 1).first().score == 1.0 or index.top(["order"], 1).count() == 1
    assert index.top([], 5).count() == 0 and index.top(["order"], 0).count() == 0
    whole = {r.entity_id: r for r in table.collect()}
    for r in index.search("controller", 9).collect():
        assert r.asDict() | {"score": None} == whole[r.entity_id].asDict() | {"score": None}


def test_common_terms_read_few_candidates(spark, tmp_path):
    rows = [(i, "t", f"n{i}", f"q{i}", f"f{i}", 1, 1, "the same old text", None) for i in range(2000)]
    table = spark.createDataFrame(rows, SCHEMA)
    term_index.build(table, str(tmp_path / "rows"), str(tmp_path / "postings"))
    index = term_index.TermIndex.at(spark, str(tmp_path))
    assert found(index.top(["old"], 5)) == [(i, 0.4) for i in range(5)]
    assert (index.reading.scored, index.reading.blocks) == (64, 1)
    # grams that are there, but not in a row, cost a second read and no wrong hit
    assert found(index.top(["sam", "textthe"], 2)) == found(search.lexical_top(table, ["sam", "textthe"], 2))
    plan = index.rows.filter(F.col("part").isin(0) & F.col("slot").isin(3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1][:60]


def test_a_block_is_posted_where_it_is_read(spark, monkeypatch):
    monkeypatch.setattr(term_index, "CHUNK", 5)
    texts = ["", "a", "abab", "😀x\u0130\x00é", "the same old text, the same old text"]
    for t in texts:
        assert {term_index._gram_of(c) for c in term_index._codes(t).tolist()} == {t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    rows = [(s, *([texts[s % 5]] * 5)) for s in range(60, 140)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["slot", *term_index.FIELDS])
    out = [r for b in term_index._block_postings(iter([batch])) for r in b.to_pylist()]
    assert len(out) == len({(r["gram"], r["block"]) for r in out})  # 80 texts, and one row for a gram and block
    for r in out:
        assert {r["block"] * 64 + i for i in range(64) if r["content"] >> i & 1} == {s for s, *t in rows if s // 64 == r["block"] and r["gram"] in t[0]}


def test_empty_term_index(spark, tmp_path):
    term_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "rows"), str(tmp_path / "postings"))
    assert term_index.TermIndex.at(spark, str(tmp_path)).search("a", 3).count() == 0
    assert term_index.grams_of("abab") == ["aba", "bab"] and term_index.grams_of("x") == ["x"]


# -- vectors --


def near_clusters(n=1200, dim=16):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, dim)) * 4
    rows = [(i, (centres[i % 12] + rng.standard_normal(dim) * 0.3).tolist()) for i in range(n)]
    rows += [(n + i, [0.0] * dim) for i in range(5)] + [(n + 10 + i, rows[3][1]) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def celled(spark, tmp_path_factory):
    table = spark.createDataFrame(near_clusters(), "entity_id long, embedding array<double>").repartition(3)
    folder = str(tmp_path_factory.mktemp("cells"))
    vector_index.build(table, f"{folder}/vectors", f"{folder}/cells")
    return table, vector_index.VectorIndex.at(spark, folder)


def test_cells_find_what_a_scan_finds(celled):
    table, index = celled
    rows = near_clusters()
    rng = np.random.default_rng(9)
    queries = [rows[5][1], rows[3][1], [-x for x in rows[8][1]], [0.0] * 16, rng.standard_normal(16).tolist(), rng.standard_normal(16).tolist()]
    for q in queries:
        for limit, digits in ((1, None), (25, 9), (3000, None)):
            assert found(index.search(q, limit, digits)) == found(search.vector_search(table, q, limit, digits))


def test_bounds_leave_few_cells(celled):
    _, index = celled
    index.search(near_clusters()[5][1], 10).collect()
    assert index.reading.vectors < 0.2 * index.reading.of_vectors and index.reading.of_vectors == 1235


def test_cells_of_few_vectors(spark, tmp_path):
    for name, rows in (("none", []), ("zero", [(1, [0.0, 0.0])]), ("one", [(1, [1.0, 2.0]), (2, [2.0, 4.0])])):
        table = spark.createDataFrame(rows, "entity_id long, embedding array<double>")
        vector_index.build(table, str(tmp_path / name / "vectors"), str(tmp_path / name / "cells"))
        index = vector_index.VectorIndex.at(spark, str(tmp_path / name))
        assert found(index.search([1.0, 1.0], 5)) == found(search.vector_search(table, [1.0, 1.0], 5))


# -- adjacency --


def walks(nodes, edges, seeds, types=None):
    nodes, edges = graph.traverse(nodes, edges, seeds, 2, types)
    return sorted(map(tuple, nodes.collect())), sorted(map(tuple, edges.collect()))


def test_walks_over_the_layout_are_the_walks_over_edges(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.randrange(200), r.randrange(210), r.choice("AB"), 1.0) for i in range(500)] + [(1000 + i, 7, i % 150, "A", 0.5) for i in range(300)] + [(5000, 3, 3, "A", 1.0), (5001, 3, 4, "A", 1.0), (5002, 3, 4, "A", 1.0)]
    edges = spark.createDataFrame(rows, "relation_id long, source_id long, target_id long, relation_type string, confidence double")
    nodes = spark.range(200).withColumnRenamed("id", "entity_id")
    seeds = spark.createDataFrame([(3,), (7,), (150,)], "seed_id long")
    for hub in (adjacency.HUB, 50):
        layout = adjacency.build(spark, nodes, edges, f"file://{tmp_path}/hub{hub}", hub=hub)
        assert (layout.hub_count > 0) == (hub == 50)
        for types in (None, ["A"]):
            assert walks(nodes, layout, seeds, types) == walks(nodes, edges, seeds, types)
        again = adjacency.Adjacency(spark, layout.folder, layout.buckets, layout.hub_count)
        assert walks(nodes, again, seeds) == walks(nodes, edges, seeds)


def test_a_walk_over_edges_sorts_none_of_them(spark, tmp_path):
    n, before = 2_000_000, spark.conf.get("spark.sql.adaptive.enabled")
    edges = spark.range(n).select(F.col("id").alias("relation_id"), F.col("id").alias("source_id"), (F.col("id") % 1000 + n).alias("target_id"), F.lit("A").alias("relation_type"), F.lit(1.0).alias("confidence"))
    nodes, seeds = spark.range(n + 900).withColumnRenamed("id", "entity_id"), spark.createDataFrame([(5,), (950,)], "seed_id long")
    edges.write.parquet(f"{tmp_path}/edges")
    nodes.write.parquet(f"{tmp_path}/nodes")
    tables = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("nodes", "edges")]
    plans = []

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = f"{tmp_path}/level{len(plans)}"
        df.write.parquet(out)
        return spark.read.parquet(out)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, looked = graph.traverse(*tables, seeds, 2, settle=settle)
        # 950's neighbour is no node
        assert found.filter("seed_id = 5").groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 1), (2, n // 1000 - 1)]
        assert found.filter("seed_id = 950").collect() == [(950, 950, 0)] and looked.count() == n // 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    reading = [p for p in plans if "/edges" in p or "/nodes" in p]
    assert len(reading) == 4 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in reading)


def test_the_layout_is_joined_without_a_shuffle_of_edges(spark, tmp_path):
    edges = spark.range(1000).select(F.col("id").alias("relation_id"), (F.col("id") % 50).alias("source_id"), (F.col("id") % 70).alias("target_id"), F.lit("A").alias("relation_type"), F.lit(1.0).alias("confidence"))
    layout = adjacency.build(spark, spark.range(100).withColumnRenamed("id", "entity_id"), edges, f"file://{tmp_path}/layout", buckets=6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = layout.step(spark.range(40).select(F.col("id").alias("at"), F.lit(1).alias("seed_id")))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert step.count() == edges.filter("source_id < 40").count() + edges.filter("target_id < 40").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    layout.close()


SEARCHES = ["lex_path_term", "lex_single_term", "lex_literal_wildcards", "lex_multi_term", "lex_project_isolation", "hybrid_rrf", "hybrid_weighted", "hybrid_weight_sweep", "hybrid_branch_diagnostics", "hybrid_degraded_keyword", "lex_structured_complete", "lex_structured_fallback"]


def test_one_search_builds_no_index(spark, monkeypatch):
    def build(*_):
        raise AssertionError("an index for one search")

    monkeypatch.setattr(term_index, "build", build)
    monkeypatch.setattr(testdata, "_BUILT", {})
    for name in SEARCHES:
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").head(1), name


def test_a_scan_rounds_before_it_orders(spark):
    table = spark.createDataFrame(some_entities(), SCHEMA)
    for query in ("order the code find", "nowhere.order"):
        every = sorted(((-round(s, 2), i) for i, s in found(search.keyword_search(table, query, 1000))))
        assert [(-s, i) for i, s in found(search.keyword_search(table, query, 20, 2))] == every[:20]
