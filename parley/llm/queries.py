"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import cover_tree, hard_negatives, importance, katz, mixing, prob_minhash, quality, quality_fm, shard_kd, sp_wfst, substring_cm, suffix_index, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_kd.shard(table(spark, sf_dir, "documents"), 24)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_index.drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = out.columns[-1]
    return out.select("doc_id", f"{s}.n_bytes", f"{s}.n_removed", f"{s}.n_spans", F.sha2(f"{s}.kept", 256).alias("kept_sha256"))


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = katz.train_and_score(docs, fold(7) != 2)
    return out.select("doc_id", (F.coalesce(fold(7) == 2, F.lit(False))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.with_rates(docs, table(spark, sf_dir, "labels"))
    m = out.columns[-1]
    return out.select("doc_id", F.col(f"{m}.tokens").alias("n_tokens"), *(F.round(f"{m}.{d}", 9).alias(f"p_{d}") for d in mixing.DOMAINS), F.round(f"{m}.rate", 9).alias("rate"), F.col(f"{m}.copies").alias("copies"))


def op5_sentencepiece_wfst(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sp_wfst.encode(docs, sp_wfst.load(model), decode=True)
    same = F.col("_e.decoded") == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", F.size("_e.ids").cast("long").alias("n_ids"), F.xxhash64("_e.ids").alias("ids_hash"), same.alias("round_trip"))


def op6_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", *(f"{out.columns[-1]}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.with_score(docs, net).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_substring_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_cm.drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = out.columns[-1]
    return out.select("doc_id", f"{s}.n_words", f"{s}.n_removed", F.sha2(f"{s}.text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = hard_negatives.build_index(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(index, F.col("vec_id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), texts=False)
    return out.select("doc_id", *(f"{out.columns[-1]}.{c}" for c in ("n_features", "weight", "score", "rank")))


def op13_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    out = quality_fm.with_quality(docs, machine)
    score = F.col(out.columns[-1])
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kd_sharding, op2_suffix_array_dedup, op3_katz_scores, op4_soft_mixing, op5_sentencepiece_wfst, op6_cover_tree_links, op7_prob_minhash, op8_quality_rules, op9_toxicity_bigru, op10_substring_cm, op11_hard_negatives, op12_importance_resampling, op13_quality_fm)
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, b, octet_length(b) AS n, hex(b) AS x FROM d),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(greatest(n - 49, 0))) AS p FROM h)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS m FROM s) WHERE m < doc_id),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(g) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS g FROM f)) GROUP BY doc_id, r),
pieces AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM runs),
agg AS (SELECT h.doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
    FROM h JOIN pieces USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN agg USING (doc_id)
"""

_OP8_BASE = f"""
w AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, p, list_slice(ws, p, p + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS p FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM pos) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)"""


def _op8() -> str:
    levels = {"s": "lang, source, measure", "l": "lang, measure", "a": "measure"}
    quant = ",\n".join(
        f"""{name} AS (SELECT {by}, max(total) AS total, {", ".join(f"min(edge) FILTER (c * 100 >= total * {p}) AS q{p}" for p in (1, 10, 50, 90, 99))} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY edge) AS c, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, edge, sum(n) AS n FROM sk GROUP BY {by}, edge)) GROUP BY {by})"""
        for name, by in levels.items()
    )
    pick = ", ".join(f"CASE WHEN s.total >= 50 THEN s.q{p} WHEN l.total >= 50 THEN l.q{p} ELSE a.q{p} END AS q{p}" for p in (1, 10, 50, 90, 99))
    return f"""
WITH {_OP8_BASE},
v AS (SELECT doc_id, lang, source, base_failed, x.m AS measure, x.v - x.v % CAST(pow(2, greatest(length(bin(x.v)) - 6, 0)) AS BIGINT) AS v FROM (SELECT *, unnest([
    {{'m': 'word_len', 'v': word_chars * 100 // n_words}}, {{'m': 'symbols', 'v': n_symbols * 1000 // word_chars}},
    {{'m': 'dup_lines', 'v': n_dup_lines * 1000 // n_words}}, {{'m': 'repeats', 'v': n_repeat_words * 1000 // n_words}}]) AS x FROM b WHERE n_words > 0)),
sk AS (SELECT lang, source, measure, v AS edge, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
{quant},
t AS (SELECT *, CASE WHEN measure IN ('dup_lines', 'repeats') THEN q99 ELSE q90 END AS high, CASE WHEN measure IN ('dup_lines', 'repeats') THEN q1 ELSE q10 END AS low
    FROM (SELECT s.lang, s.source, s.measure, {pick} FROM s JOIN l USING (lang, measure) JOIN a USING (measure))),
f AS (SELECT lang, source, measure,
    low - 3 * CASE WHEN q50 > low THEN q50 - low ELSE (q50 - q1) // 16 + 1 END AS lo,
    high + 3 * CASE WHEN high > q50 THEN high - q50 ELSE (q99 - q50) // 16 + 1 END AS hi FROM t),
bad AS (SELECT DISTINCT doc_id FROM v JOIN f USING (lang, source, measure) WHERE v > hi OR (measure = 'word_len' AND v < lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


_OP6 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.m AS component_id, comp.m = vec_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, p, list_slice(ws, p, p + 19) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS p FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM pos) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM late),
each AS (SELECT doc_id, word, q FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score FROM e a JOIN e x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""

_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS ws FROM documents),
f AS (SELECT r, unnest(ws) AS w FROM d),
g AS (SELECT unnest(ws) AS w FROM (SELECT {_FEATURES} AS ws FROM benchmark)),
steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps),
s AS (SELECT bucket, count(*) AS n FROM f JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM g JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT r, sum(gain) AS w FROM f JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
score AS (SELECT r, doc_id, len(ws) AS n, CAST(coalesce(weight.w, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight.w, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)),
place AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS k, count(*) OVER () AS total FROM score WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN k <= 10 * total // 100 THEN k END AS BIGINT) AS rank FROM score LEFT JOIN place USING (r)
"""

SQL: dict[str, str] = {"op2_suffix_array_dedup": _OP2, "op6_cover_tree_links": _OP6, "op8_quality_rules": _op8(), "op10_substring_cm": _OP10, "op11_hard_negatives": _OP11, "op12_importance_resampling": _OP12}
