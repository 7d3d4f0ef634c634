"""Retrieval metrics over rows with ``predicted`` (ranked) and ``gold`` arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260717
ITERATIONS = 10_000
TOLERANCE = 1e-12
# Fixed value: phrases of answers that refuse.
REFUSALS = ("insufficient evidence", "not enough evidence", "cannot determine", "cannot answer", "unable to answer", "unable to determine", "证据不足", "无法确定", "信息不足", "无法回答", "不能回答")


def first_rank(predicted: Column, gold: Column) -> Column:
    """Place from 1 of the first gold item, or null."""
    at = F.array_min(F.transform(gold, lambda g: F.nullif(F.array_position(predicted, g), F.lit(0).cast("long"))))
    return at


def reciprocal_rank(predicted: Column, gold: Column) -> Column:
    """0 without a hit, null without gold."""
    return F.when(F.size(gold) > 0, F.coalesce(1.0 / first_rank(predicted, gold), F.lit(0.0)))


def any_hit(predicted: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.coalesce((first_rank(predicted, gold) <= k).cast("double"), F.lit(0.0)))


def recall(predicted: Column, gold: Column, k: int) -> Column:
    """Share of distinct gold items among the first k distinct predictions."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(F.slice(F.array_distinct(predicted), 1, k), g)) / F.size(g))


def overlap(predicted: Column, gold: Column) -> list[Column]:
    """Sizes to be summed for micro precision and recall."""
    return [F.size(F.array_intersect(predicted, gold)).alias("hit"), F.size(F.array_distinct(predicted)).alias("said"), F.size(F.array_distinct(gold)).alias("have")]


def micro(df: DataFrame, predicted: str, gold: str, *keys: str) -> DataFrame:
    """Micro precision and recall (0 over nothing)."""
    sizes = df.select(*keys, *overlap(F.col(predicted), F.col(gold)))
    over = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    return sizes.groupBy(*keys).agg(over("hit", "said").alias("precision"), over("hit", "have").alias("recall"))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(1.0)


def chain_complete(predicted: Column, gold: Column) -> Column:
    return F.size(F.array_except(gold, predicted)) == 0


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Means of any-hit and fractional recall at 1, 5, 10 and of reciprocal ranks, and queries without a hit."""
    p, g = F.col("predicted"), F.col("gold")
    cells = [F.avg(any_hit(p, g, k)).alias(f"any_recall_{k}") for k in (1, 5, 10)] + [F.avg(recall(p, g, k)).alias(f"recall_{k}") for k in (1, 5, 10)]
    zero = F.sum(F.when((F.size(g) > 0) & first_rank(p, g).isNull(), 1).otherwise(0)).alias("zero_hit")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *cells, F.avg(reciprocal_rank(p, g)).alias("mrr"), zero)


def refused(answer: Column, status: Column, uncertainties: Column) -> Column:
    """Explicit refusals: a phrase, an error, or the note that the repair limit was reached."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    said = F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(text, p))
    note = F.contains(F.lower(F.array_join(uncertainties, " ")), F.lit("evidence validation repair limit reached"))
    return said | F.coalesce(status == "error", F.lit(False)) | F.coalesce(note, F.lit(False))


def pairs_by_run(runs: DataFrame) -> DataFrame:
    """Jaccard of references between each two runs of a question (question_id, run_index, refs)."""
    a, b = (runs.select("question_id", F.col("run_index").alias(f"run_{x}"), F.col("refs").alias(f"refs_{x}")) for x in "ab")
    both = a.join(b, "question_id").filter("run_a < run_b")
    return both.select("question_id", "run_a", "run_b", jaccard(F.col("refs_a"), F.col("refs_b")).alias("jaccard"))


def degeneracy(rows: DataFrame, k: int = 10) -> DataFrame:
    """For each two variants the share of questions with one and the same first k (question_id, variant, predicted)."""
    a, b = (rows.select("question_id", F.col("variant").alias(f"variant_{x}"), F.slice("predicted", 1, k).alias(f"top_{x}")) for x in "ab")
    both = a.join(b, "question_id").filter("variant_a < variant_b")
    return both.groupBy("variant_a", "variant_b").agg(F.avg((F.col("top_a") == F.col("top_b")).cast("double")).alias("identical"))


def _beats(b5: str, bm: str, f10: str) -> Column:
    """Loses no recall against base and floor and gains somewhere."""
    ok = (F.col("r10") + TOLERANCE >= F.col(f10)) & (F.col("r5") + TOLERANCE >= F.col(b5))
    return ok & ((F.col("r5") > F.col(b5) + TOLERANCE) | (F.col("mrr") > F.col(bm) + TOLERANCE))


def gated(scores: DataFrame, base: str, floor: str, groups: DataFrame | None = None, floors: tuple[float, float, float] | None = None) -> DataFrame:
    """Candidates (variant, weight, r1, r5, r10, mrr) that lose no recall against the base and floor variants and gain somewhere.

    With ``groups`` (field, value, variant, r5) none may lose recall at 5 against the base in any group.
    ``floors`` are the least recall at 10 of the floor variant and recall at 5 and mrr of the base (a
    run below one has no qualified candidate); candidates need the first two as well.
    """
    b = scores.filter(F.col("variant") == base).select(F.col("r5").alias("b5"), F.col("mrr").alias("bm"))
    f = scores.filter(F.col("variant") == floor).select(F.col("r10").alias("f10"))
    out = scores.filter(F.col("weight").isNotNull()).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(f))
    ok = _beats("b5", "bm", "f10")
    if floors is not None:
        run = (F.col("f10") + TOLERANCE >= floors[0]) & (F.col("b5") + TOLERANCE >= floors[1]) & (F.col("bm") + TOLERANCE >= floors[2])
        ok = ok & run & (F.col("r10") + TOLERANCE >= floors[0]) & (F.col("r5") + TOLERANCE >= floors[1])
    if groups is not None:
        own = groups.filter(F.col("variant") == base).select("field", "value", F.col("r5").alias("g5"))
        losers = groups.join(own, ["field", "value"]).filter(F.col("r5") + TOLERANCE < F.col("g5")).select("variant").distinct().withColumn("loses", F.lit(True))
        out = out.join(F.broadcast(losers), "variant", "left")
        ok = ok & F.col("loses").isNull()
    return out.withColumn("qualified", ok).drop("b5", "bm", "f10", "loses")


def best_weight(candidates: DataFrame) -> DataFrame:
    """The qualified candidate first by recall at 5, mrr, recall at 1, nearness to 0.7 and smallness; none is allowed."""
    return candidates.filter("qualified").orderBy(F.desc("r5"), F.desc("mrr"), F.desc("r1"), F.abs(F.col("weight") - 0.7), "weight").limit(1)


def hashed_draws(spark, n: int, iterations: int, seed: int = SEED) -> DataFrame:
    """iteration, item: n draws with replacement for each iteration, from hashes instead of a generator."""
    cells = spark.range(iterations * n).select((F.col("id") / n).cast("long").alias("iteration"), "id")
    word = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    return cells.select("iteration", (F.conv(F.substring(word, 1, 8), 16, 10).cast("long") % n).alias("item"))


def bootstrap(deltas: DataFrame, draws: DataFrame) -> DataFrame:
    """95 % interval of the mean delta (item, delta) over the draws (iteration, item), and how often it isn't negative."""
    means = draws.join(deltas, "item").groupBy("iteration").agg(F.avg("delta").alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") >= -TOLERANCE).cast("double")).alias("not_worse"))


#: Different deltas that one task draws for.
DRAWN_TOGETHER = 50_000


def bootstrap_by_groups(deltas: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """:func:`bootstrap` of any number of items: its row of low, high and not_worse, over items (delta; null ones are left out).

    A resample's mean depends on how often each different delta is drawn, and those counts are multinomial.  So items with one
    delta are a group, groups are dealt to buckets, and each iteration draws first how many of the n draws fall to
    each bucket and then, in the bucket's task, to each of its groups.  Both come from a counter-based generator under the
    seed, the iteration and the bucket, so every task agrees on the first without a shuffle and a lost task is
    repeated exactly.  Work follows the different deltas, not the items.
    """
    spark = deltas.sparkSession
    groups = deltas.filter(F.col("delta").isNotNull()).groupBy(F.col("delta").cast("double").alias("delta")).agg(F.count("*").alias("n"))
    wide = -(-groups.count() // DRAWN_TOGETHER)
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("delta"), F.lit(max(1, wide))).cast("int"))
    sizes = {r["bucket"]: r["n"] for r in groups.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row a bucket
    if not sizes:
        return spark.createDataFrame([], "low double, high double, not_worse double")
    order, total = sorted(sizes), sum(sizes.values())

    def draw(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("delta")
        bucket, own = int(rows["bucket"].iloc[0]), sizes[int(rows["bucket"].iloc[0])]
        share, values = rows["n"].to_numpy() / own, rows["delta"].to_numpy()
        first, at = np.array([sizes[b] for b in order]) / total, order.index(bucket)
        sums = np.empty(iterations)
        for i in range(iterations):
            mine = np.random.Generator(np.random.Philox(key=[seed, 0], counter=[0, 0, i, 0])).multinomial(total, first)[at] if len(order) > 1 else total
            counts = np.random.Generator(np.random.Philox(key=[seed, bucket + 1], counter=[0, 0, i, 0])).multinomial(mine, share)
            sums[i] = counts @ values
        return pd.DataFrame({"iteration": np.arange(iterations), "part": sums})

    parts = groups.groupBy("bucket").applyInPandas(draw, "iteration long, part double")
    means = parts.groupBy("iteration").agg((F.sum("part") / total).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") >= -TOLERANCE).cast("double")).alias("not_worse"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """Per omitted item and variant the mean of the others (item, variant, value): sums less the item's own."""
    w = Window.partitionBy("variant")
    return rows.select("item", "variant", ((F.sum("value").over(w) - F.col("value")) / (F.count("*").over(w) - 1)).alias("mean"))


def leave_one_out_selection(rows: DataFrame, base: str, floor: str, fields: Sequence[str] = ("language", "task_type")) -> DataFrame:
    """How often each variant is selected when each item in turn is omitted (variant, runs); the row of the null variant counts runs without a winner.

    ``rows`` has item, variant, weight (null if no candidate), r1, r5, r10, mrr and ``fields``, one row
    for each item with gold and variant. Means without an item are sums less its own; only the item's own
    groups change, so the work is linear in rows. A group left empty gates nothing; there are no absolute floors.
    """
    less = lambda total, own, n: F.when(F.col(n) > 1, (F.col(total) - F.col(own)) / F.nullif(F.col(n) - 1, F.lit(0)))
    cells = ("r1", "r5", "r10", "mrr")
    total = rows.groupBy("variant").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cells])
    # rounded within the tolerance, so that equal means tie whatever the order of their sums
    rest = rows.join(F.broadcast(total), "variant").select("item", "variant", "weight", *[F.round(less(f"s_{c}", c, "n"), 12).alias(c) for c in cells])
    group = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    grouped = rows.select("item", "variant", "r5", group.alias("g")).select("item", "variant", "r5", "g.field", F.coalesce("g.value", F.lit("None")).alias("value"))
    sums = grouped.groupBy("field", "value", "variant").agg(F.sum("r5").alias("s"), F.count("*").alias("k"))
    based = sums.filter(F.col("variant") == base).select("field", "value", F.col("s").alias("bs"))
    sums = sums.join(based, ["field", "value"]).withColumn("lost", (F.col("s") / F.col("k") + TOLERANCE < F.col("bs") / F.col("k")).cast("int"))
    every = sums.groupBy("variant").agg(F.sum("lost").alias("lost"))
    own = rows.filter(F.col("variant") == base).select("item", F.col("r5").alias("b5"))
    now = F.coalesce((less("s", "r5", "k") + TOLERANCE < less("bs", "b5", "k")).cast("int"), F.lit(0))
    change = grouped.join(own, "item").join(sums, ["field", "value", "variant"]).groupBy("item", "variant").agg(F.sum(now - F.col("lost")).alias("change"))
    w = Window.partitionBy("item")
    of = lambda variant, c: F.max(F.when(F.col("variant") == variant, F.col(c))).over(w)
    seen = rest.select("*", of(base, "r5").alias("b5"), of(base, "mrr").alias("bm"), of(floor, "r10").alias("f10"))
    fit = seen.filter(F.col("weight").isNotNull() & _beats("b5", "bm", "f10")).join(change, ["item", "variant"]).join(F.broadcast(every), "variant").filter("lost + change = 0")
    order = w.orderBy(F.desc("r5"), F.desc("mrr"), F.desc("r1"), F.abs(F.col("weight") - 0.7), "weight")
    won = fit.withColumn("place", F.row_number().over(order)).filter("place = 1").select("item", F.col("variant").alias("winner"))
    runs = rows.select("item").distinct().join(won, "item", "left").groupBy(F.col("winner").alias("variant")).agg(F.count("*").alias("runs"))
    none = rows.sparkSession.createDataFrame([(None, 0)], "variant string, runs long")
    return runs.unionByName(none).groupBy("variant").agg(F.sum("runs").alias("runs"))


def stability_subset(cases: DataFrame, size: int) -> DataFrame:
    """question_id and place of ``size`` cases (question_id, task_type, language, answerable, difficulty) that cover all strata.

    The strata are the task types, languages and answerabilities of the cases.  A case's gain is the number of its
    strata that no chosen case has; the greatest gain is next, then the hardest, then the unanswerable, then the
    greatest id.  Gains are counted by a join with the strata still open, so each round is one aggregation;
    once all strata are covered, all further places follow from one order.  Cases that can't fill or cover
    the subset are an error.
    """
    marks = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("task_type", "language", "answerable")])
    hardness = F.when(F.col("difficulty") == "hard", 3).when(F.col("difficulty") == "medium", 2).when(F.col("difficulty") == "easy", 1).when(F.col("difficulty").isNull(), 1).otherwise(0)
    own = cases.select(F.col("question_id").cast("string").alias("question_id"), marks.alias("marks"), F.struct(hardness.alias("hard"), (~F.col("answerable")).cast("int").alias("open"), F.col("question_id").cast("string").alias("id")).alias("rank"))
    strata = own.select("question_id", F.explode("marks").alias("mark"))
    left, chosen = {r["mark"] for r in strata.select("mark").distinct().collect()}, []  # as many as there are strata
    while left and len(chosen) < size:
        gains = strata.filter(F.col("mark").isin(*left)).groupBy("question_id").agg(F.count("*").alias("gain"))
        best = own.join(gains, "question_id").agg(F.max_by(F.struct("question_id", "marks"), F.struct("gain", "rank")).alias("best")).first()["best"]
        chosen.append(best["question_id"])
        left -= set(best["marks"])
    if left:
        raise ValueError(f"strata not covered: {sorted(left)}")
    spark = cases.sparkSession
    first = spark.createDataFrame([(x, i) for i, x in enumerate(chosen)], "question_id string, place int")
    rest = own.join(F.broadcast(first), "question_id", "left_anti").orderBy(F.desc("rank")).limit(max(0, size - len(chosen)))  # at most ``size`` rows
    more = rest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank"))) + (len(chosen) - 1)).select("question_id", "place")
    out = first.unionByName(more)
    if out.count() < size:
        raise ValueError(f"a subset of {size} needs as many cases")
    return out


def citation_metrics(records: DataFrame) -> DataFrame:
    """One row over answers (answer, references array<struct<citation, file_path>>, gold_files): micro precision
    and recall of cited files, and the shares of cited numbers and of files that exist."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"(?<!\w)\[(\d+)\]"), 1), lambda x: x.cast("int"))
    known = F.transform("references", lambda r: r["citation"])
    r = records.withColumn("cited", F.array_distinct(cited)).withColumn("valid", F.array_intersect("cited", known))
    files = F.array_distinct(F.transform(F.filter("references", lambda x: F.array_contains("valid", x["citation"])), lambda x: x["file_path"]))
    r = r.withColumn("files", files)
    over = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    hit = F.size(F.array_intersect("files", "gold_files"))
    return r.agg(
        over(hit, F.size("files")).alias("precision"), over(hit, F.size(F.array_distinct("gold_files"))).alias("recall"),
        over(F.size("valid"), F.size("cited")).alias("id_validity"), F.avg((F.size("cited") > 0).cast("double")).alias("cites_at_all"),
    )


def refusal_metrics(records: DataFrame) -> DataFrame:
    """One row over answers (answer, status, uncertainties, source_answerable, system_answerable, expected_uncertainties)."""
    r = records.withColumn("refused", refused(F.col("answer"), F.col("status"), F.col("uncertainties")))
    share = lambda where: F.coalesce(F.round(F.avg(F.when(where, F.col("refused").cast("double"))), 4), F.lit(0.0))
    can = F.coalesce(F.col("source_answerable"), F.lit(True))
    unsure = (F.coalesce(F.col("system_answerable"), F.lit("")) != "full") | (F.coalesce(F.size("expected_uncertainties"), F.lit(0)) > 0)
    told = F.coalesce(F.round(F.avg(F.when(unsure, (F.coalesce(F.size("uncertainties"), F.lit(0)) > 0).cast("double"))), 4), F.lit(0.0))
    return r.agg(
        F.count_if(~can).alias("unanswerable"), share(~can).alias("refusal_rate"), F.count_if(can).alias("answerable"), share(can).alias("over_refusal_rate"),
        share(can & (F.col("system_answerable") == "full")).alias("over_refusal_full"), F.count_if(unsure).alias("uncertain"), told.alias("uncertainty_compliance"),
    )


def repair_summary(events: DataFrame) -> DataFrame:
    """One row over response events (case_id, phase, ok): cases with a repair, and those it helped."""
    by = events.groupBy("case_id").agg(F.max((F.col("phase") == "repair").cast("int")).alias("tried"), F.max(((F.col("phase") == "repair") & F.col("ok")).cast("int")).alias("helped"))
    return by.agg(F.sum("tried").alias("attempted"), F.sum("helped").alias("succeeded"), (F.sum("tried") - F.sum("helped")).alias("failed"))


def comparable(own: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: whether two runs have one identity each, the same in both (columns ``keys``)."""
    one = lambda df, name: df.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("k")).agg(F.collect_set("k").alias(name))
    both = one(own, "a").crossJoin(one(other, "b"))
    same = (F.size("a") == 1) & (F.col("a") == F.col("b"))
    return both.select(F.when(same, "comparable").otherwise("not_comparable").alias("verdict"))


def reconciliation(counts: DataFrame) -> DataFrame:
    """Rows (name, total, parts array<long>) whose parts don't add up."""
    parts = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.withColumn("sum", parts).filter("sum <> total")
