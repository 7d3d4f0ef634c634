import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, line_frequency, packing, sharding, substring_dedup
from tessera.llm.automaton import SuffixAutomaton
from tessera.llm.components import components
from tessera.llm.packing import LevelArray, Packer, TokenCache
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, n string, host string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=3, n=140):
    """Random texts with copies, near copies, shared passages, shared lines, nulls and odd white space."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(900)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [prose(r.randint(30, 70)) for _ in range(4)]
    line = " ".join(prose(9))
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "one two three", "a " * 80, "a b " * 60 + "\n" + "a b " * 3, " ".join(passages[0])]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.2 and len(texts) > 12:
            texts.append(r.choice(texts))
        elif kind < 0.45 and len(texts) > 12:
            words = (r.choice(texts) or "").split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = prose(r.randint(3, 160))
            if r.random() < 0.4:
                at = r.randrange(len(words))
                words[at:at] = r.choice(passages)
            text = "".join(w + r.choice([" ", " ", "  ", "\n", "\t"]) for w in words)
            texts.append((line + "\n" if r.random() < 0.5 else "") + text)
    texts.append("x" * 5000 + " " + " ".join(prose(3000)))
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), 0, "k", "m", "h") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_frequency_matches_brute_force(docs):
    rows = {x[0]: x for x in corpus()}
    limits = {"min_docs": 5, "share": 0.01, "min_left": 0.9}
    want = dict(zip(rows, brute.line_verdicts([(x[3], x[1]) for x in rows.values()], *limits.values()), strict=True))
    got = line_frequency.line_report(docs, **limits).collect()
    assert len(got) == len(rows) and any(want.values())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(rows[r.doc_id][1])[:5]
        assert r.depleted == want[r.doc_id]
    kept = line_frequency.clean_documents(docs, **limits)
    assert kept.columns == docs.columns
    failed = {i for i, x in rows.items() if brute.base_counts(x[1])[5] or want[i]}
    assert {r.doc_id for r in kept.collect()} == set(rows) - failed


def test_line_frequency_removes_lines_and_keeps_layout(spark):
    body = [" ".join(f"w{chr(97 + i)}x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)) for i in range(8)]
    rows = [(i, f"Terms of USE 12\n{b}\n", None, "a", 0, "k", "m", "h") for i, b in enumerate(body)] + [(9, body[0], None, "b", 0, "k", "m", "h")]
    kept = line_frequency.clean_documents(spark.createDataFrame(rows, SCHEMA), min_docs=3)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: f"{b}\n" for i, b in enumerate(body)} | {9: body[0]}


@pytest.mark.parametrize(("size", "holders", "gone"), [(40, 4, True), (40, 3, False), (600, 7, True), (600, 6, False)])
def test_line_frequency_share_decides_at_every_size(spark, size, holders, gone):
    """Production limits: more than 1 % of a host's texts, and more than 3 of them."""
    body = lambda i: " ".join(f"w{i}x{chr(97 + j % 26)}{chr(97 + j // 26)}".translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(60))
    rows = [(i, ("Terms of use\n" if i < holders else "") + body(i), None, "a", 0, "k", "m", "h") for i in range(size)]
    kept = {r.doc_id: r.text for r in line_frequency.clean_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(kept) == size
    assert all(("Terms of use" in kept[i]) != gone for i in range(holders))


def test_substring_dedup_matches_brute_force(docs):
    rows = {x[0]: x for x in corpus()}
    want = dict(zip(rows, brute.removed_windows([x[1] for x in rows.values()]), strict=True))
    for most in (substring_dedup.MOST_WORDS, 150):
        got = substring_dedup.remove_repeated(docs, most=most).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        text = rows[r.doc_id][1]
        assert (r.text is None) == (text is None)
        assert hashlib.sha256(" ".join(brute.WORD.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256
        assert r.text == text or r.n_removed
    assert sum(r.n_removed for r in got) > 500


def test_substring_dedup_repeated_rows_are_copies(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, None, "a", 0, "k", "m", "h")] * 2 + [(2, text[:-1] + " z", None, None, 0, "k", "m", "h")]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 50), (1, 50), (2, 49)]


def test_suffix_automaton_against_plain_search():
    r = random.Random(1)
    seqs = [[r.randint(0, 2) for _ in range(r.randint(1, 30))] for _ in range(12)]
    auto = SuffixAutomaton()
    states = [auto.add(s) for s in seqs]
    auto.settle()
    count = lambda x: sum(s[i : i + len(x)] == x for s in seqs for i in range(len(s) - len(x) + 1))
    for s, st in zip(seqs, states, strict=True):
        assert auto.repeated(st) == [max((k for k in range(i + 2) if k == 0 or count(s[i + 1 - k : i + 1]) > 1)) for i in range(len(s))]
    other = [r.randint(0, 3) for _ in range(60)]
    assert auto.matches(other) == [max(k for k in range(i + 2) if k == 0 or count(other[i + 1 - k : i + 1])) for i in range(len(other))]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_matches_brute_force(docs, n, percent):
    rows = corpus()
    want = brute.components([(x[0], x[1]) for x in rows], n, percent)
    got = jaccard_join.JaccardJoin(docs, n, percent).documents().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    if percent == 80:  # the pipeline's limits
        kept = jaccard_join.drop_near_copies(docs, n, percent)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_jaccard_join_chains_stay_whole(spark):
    """Each text differs from the next by one word: all are one component though the ends differ."""
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words[i] = f"z{i}"
        rows.append((100 - i, " ".join(words), None, "a", 0, "k", "m", "h"))
    got = jaccard_join.JaccardJoin(spark.createDataFrame(rows, SCHEMA), 3, 90).documents().collect()
    assert {r.component_id for r in got} == {41}


def test_jaccard_join_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, None, "a", 0, "k", "m", "h"), (7, text, None, "a", 0, "k", "m", "h"), (7, text, None, "a", 0, "k", "m", "h"), (3, None, None, "a", 0, "k", "m", "h"), (None, None, None, "a", 0, "k", "m", "h")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.JaccardJoin(docs, 5, 80).documents().collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    kept = [r.doc_id for r in jaccard_join.drop_near_copies(docs).collect()]
    assert sorted(map(str, kept)) == ["3", "7", "None"] or sorted(map(str, kept)) == ["3", "None", "None"]


def test_near_copies_with_one_id_for_two_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, near, c, d, e = text("a"), text("a") + " end", text("c"), text("d"), text("e")
    rows = [(1, a), (5, near), (5, c), (5, c), (8, d), (8, e), (None, d)]
    docs = spark.createDataFrame([(i, t, None, "a", 0, "k", "m", "h") for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_copies(docs).collect()]
    assert sorted(kept) == [(1, a), (5, c), (8, d), (8, e)]


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == root and len(got) == len(root)
    partial = components(spark.createDataFrame(links, "a long, b long"), 2).collect()
    assert {x.node for x in partial} == set(root) and len(partial) == len(root) and all(root[x.root] == root[x.node] for x in partial)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {x[0]: np.array(tokenizer.encode(x[1] or "", add_special_tokens=False).ids + [2], "<u4") for x in corpus()}
    pieces = packing.pack(docs, TOKENIZER, window=256).collect()
    for i, ids in want.items():
        own = sorted((p.start, p.length, bytes(p.ids), p.doc_tokens) for p in pieces if p.doc_id == i)
        assert b"".join(p[2] for p in own) == ids.tobytes()
        assert all(p[3] == len(ids) and len(p[2]) == 4 * p[1] for p in own)
        assert [p[0] for p in own] == [sum(q[1] for q in own[:k]) for k in range(len(own))]
    sequences: dict[int, list] = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total == 256 or total & (total - 1) == 0


def test_token_cache_equals_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    cache = TokenCache(tokenizer, most=5, longest=4)
    for text in ["", "a", "Σίσυφος ΣΑΣ end", "İ ı", "it's I'LL WE'VE don't 's !!'s", "é é", "<|endoftext|> hi<|startoftext|>x", "x\x1cy\x85z\xa0w", "½ ²³ 12345 a1b2", "ÀÉ×÷ÿ ª µ º", "日本 mixed日本 text", "😀 ok", "a" * 300 + "\n" + "é" * 99, "ß ẞ SS"] * 2:
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_cache_leaves_other_tokenizers_alone():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cache = TokenCache(tokenizer)
    assert not cache.fits and TokenCache(Tokenizer.from_file(TOKENIZER)).fits
    for text in ["", "Hello  World's 12", "É ok"]:
        assert np.frombuffer(cache.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_level_array_takes_the_least_sum_of_squares():
    r = random.Random(2)
    levels, window = LevelArray(20), 20
    levels.next = 0
    counts = [0] * 20
    for k in range(400):
        size = r.randint(1, 19)
        options = []
        for h in range(0, window - size + 1):
            if h and not counts[h]:
                continue
            after = list(counts)
            if h:
                after[h] -= 1
            if h + size < window:
                after[h + size] += 1
            options.append((sum(x * x for x in after), -h))
        best = levels.best(size)
        assert (min(options)[1] == -best), (k, size)
        if best:
            levels.take(best)
            counts[best] -= 1
        levels.put(best + size, k)
        if best + size < window:
            counts[best + size] += 1


def test_packer_bounds_open_windows():
    packer, pieces = Packer(0, 64, max_open=5), []
    for i in range(200):
        pieces += packer.add(i, np.full(33 + i % 7, i, np.uint32))
        assert len(packer.open) <= 6
    pieces += packer.drain()
    assert sum(p[2] for p in pieces) == sum(33 + i % 7 for i in range(200))


def test_language_id_learns_and_marks_the_undefined(spark):
    r = random.Random(4)
    make = lambda letters, k: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(k))
    rows = [(i, make("abcdef" if i % 2 else "mnopqr", 30), "x" if i % 2 else "y") for i in range(200)]
    rows += [(300, None, "x"), (301, "12 ! 😀", "x"), (302, "", None), (303, "ab cd ef", None), (304, "𐐀𐐁 mn op", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = language_id.fit(docs.filter("doc_id < 100 or doc_id >= 300"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(docs, langs, logp, [F.col("doc_id")]).collect()}
    assert langs == ["x", "y"] and len(got) == len(rows)
    assert all(got[i][0] == ("x" if i % 2 else "y") for i in range(200))
    assert [got[i] for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303][0] == "x" and got[304][0] == "y" and all(0 <= s <= 1 for _, s in got.values())
    langs, logp = language_id.fit(docs.filter("lang is null"))
    assert {x.lang_pred for x in language_id.predict(docs, langs, logp, [F.col("doc_id")]).collect()} == {"und"}


def test_language_id_equals_plain_naive_bayes(spark):
    r = random.Random(14)
    words = {"x": "haus straße über garten mond fluß", "y": "house street over garden moon river", "z": "maison rue sur jardin lune fleuve été"}
    make = lambda lang, k: " ".join(r.choice(words[lang].split()) for _ in range(k))
    rows = [(i, make("xyz"[i % 3], r.randint(1, 9)), "xyz"[i % 3]) for i in range(60)]
    rows += [(60, "mond river été 12", None), (61, " ..Ünï x", None), (62, "", None), (63, None, None), (64, "日本 mond", None), (65, make("x", 4000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = language_id.fit(docs.filter("doc_id < 60"), bits=12)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(docs, langs, logp, [F.col("doc_id")]).collect()}
    want = brute.naive_bayes([(x[2], x[1]) for x in rows[:60]], [x[1] for x in rows], 12)
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i][0] == lang and abs(got[i][1] - score) < 2e-3, i


def test_language_id_leaves_no_language_out(spark):
    one_more = spark.range(language_id.MAX_LANGS + 1).selectExpr("id AS doc_id", "'ab cd' AS text", "'l' || id AS lang")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(one_more, bits=4)
    assert len(language_id.fit(one_more.filter(F.col("doc_id") > 0), bits=4)[0]) == language_id.MAX_LANGS


def test_sharding_keeps_sizes_even_and_groups_together(docs):
    rows = corpus()
    got = sharding.balanced_shards(docs, shards=5).collect()
    assert sorted(r.doc_id for r in got) == [x[0] for x in rows]
    load, slots = {}, {}
    for r in got:
        data = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in got)
    assert max(load.values()) - sum(load.values()) / 5 <= biggest


def test_sharding_splits_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "same text here" if i % 3 == 0 else f"own text {i}") for i in range(3000)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    mean = sum(load.values()) / 8
    assert len(got) == 3000 and all(abs(x - mean) < 0.02 * mean for x in load.values())
    held = sorted((sum(r.shard == j and r.doc_id % 3 == 0 for r in got) for j in range(8)), reverse=True)
    assert sum(held[:4]) > 800


def test_label_propagation_matches_a_plain_version(spark):
    r = random.Random(12)
    units = [(g, c, r.randint(1, 400), r.randrange(6)) for g in range(60) for c in r.sample(range(48), r.randint(1, 12))]
    target = 1.3 * sum(x[2] for x in units) / 6
    table = spark.createDataFrame(units, "grp long, chunk int, bytes long, shard int")
    luck = {x.grp: x.luck for x in table.select("grp", F.shiftrightunsigned(F.xxhash64("grp"), 1).alias("luck")).distinct().collect()}
    got = {(x.grp, x.chunk): x.shard for x in sharding.propagate(table, target, 6, 4).collect()}
    assert got == brute.propagated(units, target, 6, 4, sharding.FILL, sharding.LEAST_ROOM, luck)
    cut = lambda at: sum(at[a[:2]] != at[b[:2]] for a in units for b in units if a[0] == b[0] and a[1] < b[1])
    assert cut(got) < cut({x[:2]: x[3] for x in units}) / 2


def test_clashing_columns_pass_through(spark):
    text = lambda c: " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    extra = ["reject", "bad_lines", "__key", "key", "row_key", "spans", "__spans", "n_words", "n_removed", "kept_sha256", "copies", "copy", "shuffle_key", "__source", "rate", "drawn", "host", "body"]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(i, f"Terms of use\n{text(c)}", "a", "en", 0, *extra) for i, c in enumerate("pqrst")]
    rows += [(9, text("p") + " " + text("z"), "b", "en", 0, *extra), (None, None, None, None, None, *[None] * len(extra))]
    docs = spark.createDataFrame(rows, schema)
    import corpus_pipeline

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns, name
        kept = at.collect()
        assert kept and all([r[c] for c in extra] == extra for r in kept), name
    cut = {r.doc_id: r for r in substring_dedup.remove_repeated(docs).collect()}
    assert cut[9].n_words == 120 and cut[9].n_removed == 60 and cut[9].reject == "reject"
    assert language_id.predict(docs, ["x"], np.zeros((16, 1), np.float32), [F.col("text"), F.col("host")]).count() == 7


def test_empty_tables(empty):
    assert line_frequency.line_report(empty).count() == 0
    assert line_frequency.clean_documents(empty).count() == 0
    assert substring_dedup.remove_repeated(empty).count() == 0
    assert jaccard_join.JaccardJoin(empty).documents().count() == 0
    assert jaccard_join.drop_near_copies(empty).count() == 0
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert language_id.predict(empty, *language_id.fit(empty), [F.col("doc_id")]).count() == 0
    assert sharding.balanced_shards(empty).count() == 0


def test_jaccard_join_one_shingle_in_most_of_the_unlinked_sets(spark):
    """Sets that share a single shingle make no pair, and two linked ones among them are found."""
    r = random.Random(9)
    vocabulary = [f"v{j}" for j in range(240)]
    body = ["qq rr ss " * (i % 3 > 0) + " ".join(r.sample(vocabulary, 240)) for i in range(1000)]
    rows = [*enumerate(body), (5000, body[7] + " end")]
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    prefixes = join._postings()
    assert prefixes.groupBy("token").count().filter("count > 600").count() == 1
    roots = spark.createDataFrame([], "node long, root long")
    assert 2 <= join._banded(join._open(prefixes, roots)).select("owner").distinct().count() < 100
    got = {x.doc_id: x.component_id for x in join.documents().collect()}
    assert got == {i: i for i in range(1000)} | {5000: 7}


def test_jaccard_join_deals_a_hot_shingle_by_set(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"z{r.randint(0, 9)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = jaccard_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80).documents().collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.components(rows, 3, 80)
