import hashlib
import random
import re
import threading
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, merkle, periodic_runs, queries, shared, substring_dedup, tandem
from tests.llm.brute import WORD

SF = "/root/testdata/sf0.001"


# -- filter interaction audit --


def fails(text):
    words = WORD.findall(text)
    return {
        *("A" * (len(words) < 50)), *("B" * (100 * len(set(words)) < 65 * len(words))),
        *("C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))), *("D" * bool(re.search("[#$%&*|]", text))),
    }


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); every order walked document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    docs = []
    for i, t, s in rows:
        bad = fails(t or "")
        if (t or "") in least and (i is None or i > least[t or ""]):
            bad.add("E")
        docs.append((s or "", bad, i in good, i in toxic))
    out, shares = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, k + 1] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {(p, o, k): (*v, shares[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_is_what_walking_every_order_gives(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n", "Ab " * 3, "A" * 30, "é$ 漢", "x " * 70]
    for _ in range(70):
        texts.append(" ".join(r.choice(words[: r.choice((20, 60))]) for _ in range(r.randint(1, 120))) + r.choice(("", "", " |", " ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    rows = [(i, r.choice(texts), r.choice((None, "", "p", "q"))) for i in range(160)] + [(None, "", "p"), (None, texts[9], "q"), (None, texts[9], "p"), (5, texts[9], "r"), (5, texts[9], "r"), (6, "a" * 300_000, "r")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 170, 2)] + [(2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, source string, mask int, part string").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in filter_audit.audit(docs, table).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_parity_sums_invert_to_masks(spark):
    seen = spark.range(1000).select(F.lit("p").alias("part"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), (F.xxhash64("id") % 32).cast("int").alias("mask")).withColumn("mask", F.abs("mask"))
    want = {x["mask"]: x["count"] for x in seen.groupBy("mask").count().collect()}
    assert list(filter_audit.parity_sums(seen).select(filter_audit.cells(F.col("sums"))).first()[0]) == [want.get(m, 0) for m in range(32)]


# -- periodic runs --


def plain_runs(words, least, times):
    """Every period compared at every place."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    s = np.array([number[w] for w in words], np.int64)
    found = []
    for q in range(1, len(s) // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (s[:-q] == s[q:]).astype(int), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            length = b - a + q
            # within a longer stretch of a shorter period this period is no least one
            if length >= max(least, times * q) and not any((s[a : a + length - p] == s[a + p : a + length]).all() for p in range(1, q) if q % p == 0):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_report(words):
    found = plain_runs(words, 24, 3)
    dropped = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(kept))


def test_runs_of_short_alphabets():
    r = random.Random(8)
    for _ in range(1500):
        n, letters = r.randint(0, 60), r.choice((1, 2, 2, 3, 4))
        s = [r.randrange(letters) for _ in range(n)]
        if n > 8 and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 8)
            s[a:] = [s[min(n - 1, a + i % p)] for i in range(n - a)]
        words = [b"%d" % x for x in s]
        for least, times in ((2, 2), (6, 3), (24, 3)):
            assert periodic_runs.find_runs(words, least, times) == plain_runs(words, least, times), s


def test_runs_of_long_repetitive_sequences():
    a, b = "0", "01"
    while len(b) < 3000:
        a, b = b, b + a
    for s in ([0] * 3000, [i % 700 for i in range(3000)], list(map(int, b[:3000])), [*range(500), *range(500), *range(500), *[7] * 40, *range(500)]):
        assert tandem.runs(np.unique(s, return_inverse=True)[1]) == plain_runs([b"%d" % x for x in s], 24, 3)


def test_locus_and_blocks():
    s = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1])
    names = tandem.Names(s)
    places = np.argsort(names.rank)
    lcp = [0, *names.forwards(places[:-1], places[1:]).tolist()]
    assert tandem.blocks(places.tolist(), list(lcp)) == [0, 1, 2, 6, 7]
    low, high = tandem.SuffixTree(lcp).locus(int(names.rank[0]), 2)
    assert sorted(places[low : high + 1].tolist()) == [0, 2, 4, 7]
    assert names.backwards(np.array([5]), np.array([3])).tolist() == [4]


def test_periodic_runs_of_odd_rows(spark):
    r = random.Random(2)
    words = [f"é{i}" for i in range(200)]
    texts = [None, "", " \t\r\n\v\f", "a " * 23, "a\n" * 24, "a " * 100_000, "x " + "a b c " * 30 + "y " + "a b c " * 9, "a b " * 30]
    texts += [" ".join([r.choice(words) for _ in range(r.randint(0, 99))] + [r.choice(words)] * r.choice((0, 24, 50)) + [*words[:9]] * r.randint(1, 5)) for _ in range(40)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b " * 30, None, None), (3, texts[3], "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, seed int")
    found = periodic_runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    mine = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in found)
    want = []
    for i, t, _, _ in rows:
        w = WORD.findall(t or "")
        a = plain_runs(w, 24, 3) if len(w) < 5000 else [(0, len(w), 1)]
        gone = {k for s, n, q in a for k in range(s + q, s + n)}
        want.append((i if i is not None else -1, len(w), a, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert mine == sorted(want)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, times=1)


def test_highest_run_breaks_ties_by_start_and_period(spark):
    rows = [([(4, 24, 2), (0, 12, 1), (3, 24, 2)],), ([(1, 30, 7), (1, 60, 14), (9, 31, 7)],), ([],)]
    got = [x[0] for x in spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>").coalesce(1).select(periodic_runs.highest(F.col("runs"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(0, 12, 1), (9, 31, 7), None]


def test_periodic_query_over_a_whole_table(spark):
    got = {x.doc_id: tuple(x)[1:] for x in queries.op12_periodic_runs(spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert got.pop(doc_id) == plain_report(words)
    assert not got


# -- fingerprints --


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaves(text):
    return [sha(x) for x in re.split(r"(?<=\n)", text or "")]


def plain_root(text):
    sections, own = [], []
    for digest in leaves(text):
        own.append(digest)
        if digest[0] in "01":
            sections.append(own)
            own = []
    return sha("".join(sha(" ".join(x)) for x in [*sections, *([own] if own else [])]))


def plain_near(a, b):
    if a == b:
        return 1.0
    x, y = (set(re.split(r"(?<=[.,;:!?dsy][ \n])", t)) for t in (a, b))
    size = lambda s: sum(map(len, s))
    return 2 * size(x & y) / (size(x) + size(y))


def pages(n=60):
    r = random.Random(6)
    line = lambda: " ".join(r.choice(("the", "cats", "and", "dogs", "é漢", "ran.", "a,")) for _ in range(r.randint(0, 12)))
    texts = [None, "", "\n", "a", "a\n", "\n\n", "😀😀 b", "z" * 200_000]
    return texts + ["\n".join(line() for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_roots_and_likeness(spark):
    texts = pages()
    table = spark.createDataFrame([(i, t, texts[i - 1], "l") for i, t in enumerate(texts)], "doc_id int, text string, other string, leaves string")
    trees = merkle.fingerprint(table)
    assert trees.columns == [*table.columns, "fingerprint", "sections", "leaves_"]
    for x in trees.collect():
        assert x.leaves_ == leaves(x.text) and x.fingerprint == plain_root(x.text or "") and " ".join(x.sections).split(" ") == leaves(x.text)
    a, b = (merkle.body(F.col(c)) for c in ("text", "other"))
    roots = tuple(merkle.root(merkle.leaf_digests(x)) for x in (a, b))
    for x in table.select("text", "other", merkle.likeness(merkle.phrases(a), merkle.phrases(b), roots).alias("near")).collect():
        assert x.near == plain_near(x.text or "", x.other or "")


def test_edits_are_located(spark):
    base = "\n".join(f"line {i}" for i in range(400))
    lines = base.split("\n")
    changed = "\n".join([*lines[:50], "new", *lines[50:200], "line 200 edited", *lines[201:]])
    table = spark.createDataFrame([("a", changed, base), ("b", base, base), ("c", "x", None), ("d", None, None), ("e", base, changed)], "start string, text string, other string")
    spans = {}
    for x in merkle.edits(table, "start").collect():
        spans.setdefault(x[0], []).append((x[1], x[2]))
    at = changed.index("new"), changed.index("line 200 edited")
    assert sorted(spans.pop("a")) == [(at[0], 4), (at[1], 16)]
    assert spans.pop("e") == [(base.index("line 200\n"), 9)]
    assert spans == {"c": [(0, 1)]}


def test_next_text_is_the_next_lower_id(spark):
    r = random.Random(5)
    rows = [(i, f"t{i}") for i in r.sample(range(-500, 500), 300)] + [(None, "n1"), (None, "n2"), (7000, None), (-(2**63), "least")]
    table = spark.createDataFrame([(*x, "key", True) for x in rows], "doc_id long, text string, key string, guest boolean").repartition(7)
    for ranges in (1, 5, 64):
        got = merkle.with_next(table, ranges).collect()
        assert sorted(map(str, ((x.doc_id, x.text) for x in got))) == sorted(map(str, rows))
        after = {(x.doc_id, x.text): x.next_text for x in got}
        order = sorted((x for x in rows if x[0] is not None), reverse=True)
        for x, y in zip(order, order[1:], strict=False):
            assert after[x] == y[1]
        last = after[order[-1]]
        assert last in ("n1", "n2")
        rest = ({"n1", "n2"} - {last}).pop()
        assert after[None, last] == rest and after[None, rest] == order[0][1]
    one = spark.createDataFrame([(4, "only")], "doc_id long, text string")
    assert [tuple(x) for x in merkle.with_next(one).collect()] == [(4, "only", "only")]
    assert merkle.with_next(one.limit(0)).count() == 0
    twins = spark.createDataFrame([(1, "a")] * 5 + [(0, "b")], "doc_id long, text string").repartition(4)
    assert sorted((x.text, x.next_text) for x in merkle.with_next(twins, 3).collect()) == [("a", "a")] * 4 + [("a", "b"), ("b", "a")]


def test_edited_text(spark):
    rows = [("abcdef", "XYZW"), ("abcde", "X"), ("", "Q"), ("a", "Q"), ("😀😀😀", "é"), ("ab", "")]
    got = [x[0] for x in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(merkle.edited(F.col("a"), F.col("b"))).collect()]
    assert got == ["abcXYZ", "abcX", "", "a", "😀😀é", "a"]


def test_fingerprint_query_over_a_whole_table(spark):
    rows = sorted(((d, t or "") for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {x.doc_id: x for x in queries.op13_merkle_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half, x = len(text) // 2, got[i]
        edited = text[: len(text) - half] + after[:half]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(text), sha(edited), plain_root(text), plain_root(edited))
        assert (x.near_edited, x.near_next) == (plain_near(text, edited), plain_near(text, after))
    near = [x.near_edited for x in got.values()]
    assert sum(near) / len(near) > 0.4 and sum(x.near_next for x in got.values()) / len(near) < 0.05


# -- shared folders and names --


def test_scratch_removes_its_own_thread_s_folders_only(spark):
    seen = {}

    def other():
        seen["other"] = shared.settle(spark.range(3), "other")

    with shared.scratch(spark):
        seen["mine"] = shared.settle(spark.range(3), "mine")
        worker = threading.Thread(target=other)
        worker.start()
        worker.join()
    assert not shared.path_exists(spark, seen["mine"]._settled) and seen["other"].count() == 3
    with pytest.raises(RuntimeError), shared.scratch(spark):
        seen["failed"] = shared.settle(spark.range(3), "failed")
        raise RuntimeError
    assert not shared.path_exists(spark, seen["failed"]._settled)
    with shared.scratch(spark):
        with shared.scratch(spark):
            inner = shared.settle(spark.range(1), "inner")
        kept = shared.settle(spark.range(1), "kept")
        assert not shared.path_exists(spark, inner._settled) and kept.count() == 1


def test_repeated_passages_with_names_of_any_case_and_sign(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, text + " end", 6, "y"), (3, None, None, None)], "doc_id long, text string, N_Words int, `od``d na.me` string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeated(docs).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "od`d na.me", "n_words", "n_removed", "kept_sha256"]
    assert (got[1]["n_words"], got[1]["n_removed"], got[2]["n_words"], got[2]["n_removed"], got[2]["od`d na.me"]) == (40, 40, 41, 40, "y")
    assert got[3]["n_words"] == 0 and got[2]["text"].strip() == "end"
