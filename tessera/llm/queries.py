"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, filter_audit, jaccard_join, language_id, line_frequency, merkle, mixing, packing, periodic_runs, sharding, shared, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _line_verdicts(report: DataFrame) -> DataFrame:
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        line_frequency.base_failed().alias("base_failed"),
        (~line_frequency.base_failed() & ~F.col("depleted")).alias("kept"), "removed_words",
    )


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_verdicts(line_frequency.line_report(_table(spark, sf_dir, "documents")))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    langs, logp = language_id.fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    out = language_id.predict(docs, langs, logp, [F.col("doc_id").cast("long").alias("doc_id")])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "fill")


HARD = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    out = chat.format_conversations(rows.unionByName(hard))
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id", "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated(docs, with_text=False)


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.rates(docs))


def _event(rows: DataFrame, op: str, tokenizer: str, tokens, old=None) -> DataFrame:
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: whole texts' tokens under two public tokenizers, the first's
    revised to count the end token that packing adds, deletes of toxic rows.

    Each batch is committed twice; the second time has no effect.
    """
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    paths = [public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")]
    facts = shared.settle(packing.token_lengths(docs, *paths, ["doc_id", "source", "lang"]), "facts")
    gone = facts.join(toxic, "doc_id", "left_semi")
    word, ended, byte = F.col("word_tokens"), F.col("word_tokens") + 1, F.col("byte_tokens")
    rollup = token_counts.Rollup(spark, every=2)
    batches = {
        "0001": _event(facts, "insert", "word-bpe-49k", word),
        "0002": _event(facts, "insert", "byte-bpe-50k", byte),
        "0003": _event(facts, "revise", "word-bpe-49k", ended, word),
        "0004": _event(gone, "delete", "word-bpe-49k", ended).unionByName(_event(gone, "delete", "byte-bpe-50k", byte)),
    }
    for name, events in batches.items():
        rollup.commit(name, events)
        rollup.commit(name, events)
    return rollup.totals()


def rollup_of_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup over two measures of length that SQL has (not tokens), revised counts, deletes of toxic rows.

    Each batch is committed twice; the second time has no effect.
    """
    docs = _table(spark, sf_dir, "documents")
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", "source", "lang",
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("blanks"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"),
        F.floor((F.octet_length(text) + 3) / 4).cast("long").alias("quarters"),
    )
    facts = shared.settle(facts, "facts")
    gone = facts.join(toxic, "doc_id", "left_semi")

    blanks, lines, quarters = F.col("blanks"), F.col("blanks") + F.col("breaks"), F.col("quarters")
    rollup = token_counts.Rollup(spark)
    batches = {
        "0001": _event(facts, "insert", "blank-1", blanks),
        "0002": _event(facts, "insert", "quarter-1", quarters),
        "0003": _event(facts, "revise", "blank-1", lines, blanks),
        "0004": _event(gone, "delete", "blank-1", lines).unionByName(_event(gone, "delete", "quarter-1", quarters)),
    }
    for name, events in batches.items():
        rollup.commit(name, events)
        rollup.commit(name, events)
    return rollup.totals()


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.JaccardJoin(_table(spark, sf_dir, "documents")).documents()
    return found.select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def looped(words: list[bytes], seed: int) -> list[bytes]:
    """Of every tenth seed a text whose words, from one on, repeat with a period."""
    if seed % 10 or not words:
        return words
    n, g = len(words), seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), seed=seed, rewrite=looped)
    best = periodic_runs.highest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = (F.col(f"best.{c}") for c in ("start", "length", "period"))
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = merkle.with_next(_table(spark, sf_dir, "documents"))
    text, after = merkle.body(F.col("text")), merkle.body(F.col("next_text"))
    three = texts.select("doc_id", text.alias("text"), merkle.edited(text, after).alias("edited"), after.alias("after"))
    sides = ("text", "edited", "after")
    trees = three.select("doc_id", "text", "edited", *[f(F.col(c)).alias(f"{name}_{c}") for name, f in (("leaves", merkle.leaf_digests), ("phrases", merkle.phrases)) for c in sides])
    tops = trees.select("*", *[merkle.root(F.col(f"leaves_{c}")).alias(f"root_{c}") for c in sides])
    like = lambda c: merkle.likeness(F.col("phrases_text"), F.col(f"phrases_{c}"), (F.col("root_text"), F.col(f"root_{c}")))
    return tops.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("root_text").alias("fingerprint"), F.col("root_edited").alias("edited_fingerprint"), like("edited").alias("near_edited"), like("after").alias("near_next"),
        F.size(F.array_except("leaves_edited", "leaves_text")).cast("long").alias("changed_paragraphs"),
    )


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_frequency, op3_language_id, op4_rotated_codes, op5_label_propagation, op6_chat_format, op7_suffix_automata, op8_poisson_mixing, op9_token_counts, rollup_of_lengths, op10_jaccard_join, op11_filter_audit, op12_periodic_runs, op13_merkle_fingerprints)}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLD = "regexp_replace(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')"
_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e'), ': ', '\\c')"

ORACLE_SQL: dict[str, str] = {
    "op2_line_frequency": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT r, host, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM d),
folded AS (SELECT r, host, t, line, {_FOLD.format("line")} AS f, len({_WORDS.format("line")}) AS k FROM lines),
held AS (SELECT host, f, count(DISTINCT r) AS n FROM folded GROUP BY ALL), hosts AS (SELECT host, count(*) AS h FROM d GROUP BY host),
bad AS (SELECT host, f FROM held JOIN hosts USING (host) WHERE n > {line_frequency.FEW_DOCS} AND n > h * {line_frequency.SHARE}),
gone AS (SELECT r, sum(k) AS g FROM folded JOIN bad USING (host, f) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
pos AS (SELECT r, w, generate_subscripts(w, 1) AS i FROM d),
gram AS (SELECT r, i, w[i:i + 2] AS g FROM pos WHERE i <= len(w) - 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
base AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(g, 0) AS g FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (g > 0 AND n_words - g < n_words * {line_frequency.MIN_LEFT}) AS kept, g::BIGINT AS removed_words FROM v""",
    "op4_rotated_codes": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op6_chat_format": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{HARD}' FROM range(2) t(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('### ' || {_ESCAPED.format("role")} || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op7_suffix_automata": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), pos AS (SELECT r, w, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, i, hash(w[i:i + 34]) AS h FROM pos WHERE i <= len(w) - 34),
twice AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
out_ AS (SELECT r, list(j) AS gone FROM twice GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': i}}), lambda p: NOT coalesce(list_contains(gone, p.i), false)), lambda p: p.x), ' '), '')) AS kept_sha256 FROM d LEFT JOIN out_ USING (r)""",
    "op8_poisson_mixing": f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT source, round((SELECT sum(n) FROM s)::DOUBLE * pow(n::DOUBLE, {mixing.TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {mixing.TEMPERATURE})) FROM s) / n, 9) AS rate FROM s),
u AS (SELECT d.*, rate, ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d JOIN t USING (source)),
c AS (SELECT *, len(list_filter(range(0, 60), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1.0)))) <= u))::INT AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copies, copy::INT AS copy, md5('{mixing.SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM c WHERE copies > 0)""",
    "rollup_of_lengths": """
WITH f AS (SELECT *, coalesce(text, '') AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
e AS (SELECT source, lang, 'blank-1' AS tokenizer, length(t) - length(replace(t, ' ', '')) + 1 + length(t) - length(replace(t, chr(10), '')) AS tokens FROM f UNION ALL SELECT source, lang, 'quarter-1', (strlen(t) + 3) // 4 FROM f)
SELECT source, lang, tokenizer, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM e GROUP BY ALL""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM d),
k AS (SELECT doc_id, hash(g) AS h FROM s), z AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id FROM d LEFT JOIN z ON z.doc_id = d.doc_id""",
    "op11_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(t.doc_id > least, false) AS e FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
k AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
z AS (SELECT *, 1 << (instr('ABCDE', filter_order[step]) - 1) AS f, list_sum([1 << (instr('ABCDE', filter_order[i]) - 1) for i in range(1, 6) if i < step]) AS p FROM k),
y AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & (coalesce(p, 0) | f) = 0) AS kept, sum(n) FILTER (mask & f > 0 AND mask & coalesce(p, 0) = 0) AS removed, sum(n) FILTER (mask & f > 0 AND mask & coalesce(p, 0) > 0) AS redundant,
  sum(n) FILTER (mask = f) AS unique_fails, sum(n) FILTER (good AND mask & f > 0 AND mask & coalesce(p, 0) = 0) AS good_lost, sum(n) FILTER (toxic AND mask & f > 0 AND mask & coalesce(p, 0) = 0) AS toxic_lost FROM m, z GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM y""",
    "op13_merkle_fingerprints": rf"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS i, count(*) OVER () AS n FROM documents),
d AS (SELECT a.doc_id, a.t, b.t AS x, length(a.t) // 2 AS h FROM r a JOIN r b ON b.i = a.i % a.n + 1),
e AS (SELECT doc_id, [t, substr(t, 1, length(t) - h) || substr(x, 1, h), x] AS s FROM d),
p AS (SELECT *, [list_transform(string_split(y, chr(10)), lambda v, i: v || CASE WHEN i < len(string_split(y, chr(10))) THEN chr(10) ELSE '' END) for y in s] AS l, [list_distinct(string_split(regexp_replace(y, '([.,;:!?dsy][ \n])', '\1' || chr(1), 'g'), chr(1))) for y in s] AS f FROM e),
g AS (SELECT *, [[sha256(v) for v in y] for y in l] AS q FROM p),
c AS (SELECT *, [sha256(array_to_string([sha256(v) for v in string_split(regexp_replace(array_to_string([v || CASE WHEN v[1] IN ('0', '1') THEN chr(10) ELSE ' ' END for v in y], ''), '[ \n]$', ''), chr(10))], '')) for y in q] AS z,
  [list_sum([length(v) for v in y]) for y in f] AS k, coalesce(list_sum([length(v) for v in f[1] IF list_contains(f[2], v)]), 0) AS b2, coalesce(list_sum([length(v) for v in f[1] IF list_contains(f[3], v)]), 0) AS b3 FROM g)
SELECT doc_id, length(s[1]) AS n_chars, sha256(s[2]) AS edited_sha256, z[1] AS fingerprint, z[2] AS edited_fingerprint,
  CASE WHEN z[1] = z[2] THEN 1.0::DOUBLE WHEN k[1] + k[2] > 0 THEN (2 * b2)::DOUBLE / (k[1] + k[2])::DOUBLE ELSE 0.0::DOUBLE END AS near_edited, CASE WHEN z[1] = z[3] THEN 1.0::DOUBLE WHEN k[1] + k[3] > 0 THEN (2 * b3)::DOUBLE / (k[1] + k[3])::DOUBLE ELSE 0.0::DOUBLE END AS near_next,
  len(list_distinct([v for v in q[2] if NOT list_contains(q[1], v)]))::BIGINT AS changed_paragraphs FROM c""",
}
