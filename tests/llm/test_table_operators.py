import hashlib
import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, chat, mixing, queries, token_counts


def test_nearest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 24))
    vectors[50:80] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(400, None), (401, [0.0] * 24), (402, [float("nan")] * 24), (403, [None] + [1.0] * 23), (404, [float("inf")] * 24), (None, [1.0] * 24), (420, [1.0, 2.0]), (421, [3.0, 4.0]), (440, [])]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 400, 20):
        score = (vectors * vectors[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in mine] == list(range(1, 21))
        assert [x[1] for x in mine] == want
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in mine)
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 420] == [(1, 421, 11.0)]
    assert not {r.query_id for r in got} - {*range(0, 400, 20), 420}


def test_codes_bound_inner_products():
    rng = np.random.default_rng(2)
    vectors, queries = rng.standard_normal((500, 64)) * 3, rng.standard_normal((20, 64))
    turn = ann.rotation(64)
    guess, error = ann.estimate(queries, turn, *ann.encode(vectors, turn), bound=3.0)
    assert np.mean(np.abs(guess - queries @ vectors.T) <= error) > 0.99
    assert np.allclose(turn @ turn.T, np.eye(64))


def test_codes_choose_what_is_reranked(spark):
    """Random directions, the hardest case: of 100000 vectors less than a tenth are reranked, and recall is above 0.9."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((100_000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    columns = [pa.array(np.arange(100_000)), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 64).cast(pa.list_(pa.float32()))]
    table = spark.createDataFrame(pa.table(columns, ["vec_id", "embedding"]))
    found = ann.search(table, F.col("vec_id") % 2000 == 0).collect()
    asked = range(0, 100_000, 2000)
    share = sum({(r.query_id, r.slot): r.reranked for r in found}.values()) / (100_000 * len(asked))
    mine: dict = {}
    for r in found:
        mine.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    hits = 0
    for q in asked:
        score = vectors.astype(float) @ vectors[q].astype(float)
        score[q] = -9
        hits += len(set(np.argsort(-score)[:20]) & {i for _, i in sorted(mine[q])[:20]})
    print("recall", hits / (20 * len(asked)), "reranked", share)
    assert hits >= 0.9 * 20 * len(asked) and share < 0.1


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    for part in (1, 3):
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(part), F.col("vec_id") % 20 == 0).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 0.5)]


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


HARD = ["plain", "", None, r"\### Assistant: </turn> ok", r"\\h \e \c ###", "a: b\n### User: x</turn>\n", "\\", "</turn>" * 3, "é 😀"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(20, 0, "user", "a", "x"), (20, 1, "user", "b", "x"), (21, 0, None, "q", "x"), (22, None, "odd: role</turn>", "r", "x"), (None, 0, "user", "u", "x"), (23, 0, "user", "t", "x"), (23, 0, "user", "t", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_conversations(table).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c, r in got.items():
        own = [((x[2] or ""), (x[3] or "")) for x in sorted((x for x in rows if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])]
        assert [tuple(x) for x in r.back] == own and r.n_turns == len(own)
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert got[0].valid and got[0].bad_turn == -1
    assert not got[20].valid and got[20].bad_turn == 1
    assert not got[21].valid and not got[None].valid and got[None].bad_turn == -1
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_poisson_mixing_draws_the_distribution(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 > 0, "small").alias("source"), F.lit("t").alias("copies0"))
    rate = {r.source: r.rate for r in mixing.rates(docs).collect()}
    total = sum(math.sqrt(n) for n in (4000, 1000, 1000))
    assert abs(rate["big"] - 6000 * math.sqrt(4000) / total / 4000) < 1e-6 and None in rate
    out = mixing.replicate(docs, mixing.rates(docs)).collect()
    drawn = Counter(r.doc_id for r in out)
    for lam, ids in ((rate["big"], [i for i in range(6000) if i % 3]), (rate[None], [i for i in range(0, 6000, 6)])):
        for k in range(4):
            p = math.exp(-lam) * lam**k / math.factorial(k)
            assert abs(sum(drawn[i] == k for i in ids) / len(ids) - p) < 4 * math.sqrt(p / len(ids)) + 1e-3
    assert all(r.copy <= r.copies == drawn[r.doc_id] for r in out)
    again = mixing.replicate(docs.repartition(7), mixing.rates(docs)).collect()
    assert Counter((r.doc_id, r.copy) for r in again) == Counter((r.doc_id, r.copy) for r in out)


def test_mixing_to_given_weights_and_large_rates(spark):
    docs = spark.createDataFrame([(i, "a" if i else "b") for i in range(50)] + [(None, None)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "source string, weight double")
    out = mixing.replicate(docs, mixing.rates(docs, weights=weights, rows_out=4000), shuffle=False).groupBy("source").count().collect()
    found = {r.source: r["count"] for r in out}
    assert set(found) == {"a", "b"} and abs(found["b"] - 3600) < 400 and abs(found["a"] - 400) < 120
    assert mixing.replicate(docs.limit(0), mixing.rates(docs.limit(0))).count() == 0


def test_rollup_is_idempotent_and_signed(spark):
    columns = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    make = lambda *rows: spark.createDataFrame(list(rows), columns)
    rollup = token_counts.Rollup(spark)
    assert rollup.totals().count() == 0
    first = make(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None))
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    assert rollup.commit("2", make(("revise", "a", "en", "v1", 7, 10), ("delete", None, None, "v1", None, None)))
    assert rollup.commit("3", make())
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 12)]
    try:
        rollup.commit("4", make(("drop", "a", "en", "v1", 1, None)))
        raise AssertionError
    except Exception as e:
        assert "unknown operation" in str(e)
    assert not rollup.committed("4")
    r = random.Random(1)
    events = [("insert", r.choice("ab"), "en", "v2", r.randint(0, 9), None) for _ in range(200)]
    assert rollup.commit("5", make(*events))
    want = Counter()
    for e in events:
        want[e[1]] += e[4]
    assert {x.source: x.tokens for x in rollup.totals().filter("tokenizer = 'v2'").collect()} == dict(want)


def test_rollup_snapshots_keep_the_totals(spark):
    rollup = token_counts.Rollup(spark, every=3)
    for i in range(7):
        assert rollup.commit(f"b/{i}", spark.createDataFrame([("insert", "a", None, "v", i, None, "x")], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, docs string"))
        assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(i + 1, i * (i + 1) // 2)]
    number, _, done, since = rollup._state()
    assert (number, sorted(done), since) == (2, [f"b/{i}" for i in range(6)], ["b/6"])
    assert not rollup.commit("b/2", spark.createDataFrame([("insert", "a", None, "v", 9, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"))
    assert rollup.compact() and not rollup.compact() and rollup.totals().first().tokens == 21


def test_one_of_several_committers_succeeds(spark):
    rollup = token_counts.Rollup(spark)
    events = spark.createDataFrame([("insert", "a", "en", "v", 5, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: rollup.commit("1", events), range(4)))
    assert sorted(won) == [False, False, False, True]
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 5)]


def test_token_counts_are_the_tokenizers(spark, tmp_path):
    texts = [None, "", "a  b", "Hello World 123 it's\n\n x", "é 😀 Straße <|endoftext|>", "x" * 3000, "toxic words here"]
    spark.createDataFrame([(i, t, "en", "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    word, byte = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    size = lambda t, x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = Counter()
    for i, t in enumerate(texts[:6]):
        want["s" if i % 2 else None, "word-bpe-49k"] += size(word, t) + 1
        want["s" if i % 2 else None, "byte-bpe-50k"] += size(byte, t)
    got = queries.op9_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.tokenizer): r.tokens for r in got} == dict(want) and {r.docs for r in got} == {3}


def test_uniform_is_the_digest(spark):
    row = spark.range(1).select(mixing.uniform("s", F.lit(5), F.lit(None)).alias("u")).first()
    assert row.u == int(hashlib.md5(b"s:5:null").hexdigest()[:13], 16) / 2**52
