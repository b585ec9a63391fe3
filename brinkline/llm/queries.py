"""The ``opN_`` queries: each applies its operator to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, jaccard, langid, pii, quality, secrets, sentencepiece_nbest, spelling, suffix_dedup, toxicity, vector_dedup, warc
from .common import held_out, table, written


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"), pii.fit(spark))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def piece_model() -> str:
    """Place of the public piece vocabulary; a parameter of the operator."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_nbest.encode(table(spark, sf_dir, "documents"), piece_model(), n=3)
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "score", "alternatives", "round_trip")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_equal", "doc_at", "item_at")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, train=~held_out())
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(spark, table(spark, sf_dir, "pages"), with_payload=False)
    c = F.col("capture")
    return found.select(warc.page_id(c["id"]).alias("page_id"), c["payload_bytes"].alias("payload_bytes"), c["digest"].alias("payload_digest"), c["type"].alias("record_type"), warc.page_id(c["refers_to"]).alias("refers_to"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~held_out("id"))
    found = toxicity.score(docs, index)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "neighbours")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.neighbours(table(spark, sf_dir, "embeddings"), least=0.93)


def byte_vocabulary() -> str:
    """Place of the public byte-level vocabulary; a parameter of the operator."""
    return os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = byte_vocabulary(), piece_model()
    counts = ("n_a", "n_b", "n_groups")
    found = align.align(table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = written(found.select("doc_id", *counts, digest.alias("groups_sha256"), "links"), "aligned")
    return align.score(found, align.pair_counts(found, align.pieces(files[1])), keep=("doc_id", *counts, "groups_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS sha FROM p),
f AS (SELECT sha, min(page_id) AS first FROM d GROUP BY sha),
b AS (SELECT page_id, n, d.sha, first, list_transform(range(4), lambda k: ('0x' || substr(d.sha, (1 + 10 * k)::INT, 10))::UBIGINT) AS w FROM d JOIN f ON d.sha = f.sha)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((w[1 + i // 8] >> (35 - 5 * (i % 8))::UBIGINT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


OP10_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda t: t * t))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR isnan(t) OR isinf(t))) = 0 AND len(list_filter(embedding, lambda t: t <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON a = vec_id LEFT JOIN n ON x = vec_id
"""


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, lang IS NULL AS no_lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(p)),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g), unnest(range(5)) AS u(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, no_lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS upper_, length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS marks FROM w LEFT JOIN c ON w.doc_id IS NOT DISTINCT FROM c.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  [floor(1000 * n_symbols / greatest(n_words, 1)), floor(1000 * marks / greatest(word_chars, 1)), floor(1000 * upper_ / greatest(word_chars, 1)), floor(1000 * n_dup_lines / greatest(n_lines, 1)),
   floor(1000 * n_repeat_words / greatest(n_words, 1)), floor(10 * word_chars / greatest(n_words, 1)), floor(1000 * n_words / greatest(word_chars, 1))] AS v FROM m),
l AS (SELECT lang, no_lang, v, quality = 1 AS good, substr(md5(f.doc_id::VARCHAR), 1, 1) < '4' AS proposes FROM f JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL AND substr(md5(f.doc_id::VARCHAR), 1, 1) < 'c'),
r AS (SELECT lang, no_lang, r, v[r] AS x FROM l, unnest(range(1, 8)) AS u(r) WHERE good AND proposes),
a AS (SELECT DISTINCT lang, no_lang, r, x, count(*) OVER (PARTITION BY lang, no_lang, r) AS n, count(*) OVER (PARTITION BY lang, no_lang, r ORDER BY x DESC RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY lang, no_lang, r, x) AS above FROM r),
k AS (SELECT lang, no_lang, step, r, min(x) AS x FROM a, (VALUES (0, 0.0), (1, 0.001), (2, 0.002), (3, 0.005), (4, 0.01)) AS s(step, level) WHERE above <= floor(level::DOUBLE * n) GROUP BY ALL),
o AS (SELECT lang, no_lang, step, list(x ORDER BY r) AS x FROM k GROUP BY ALL),
j AS (SELECT l.*, step, len(list_filter(range(1, 8), lambda i: v[i] > x[i])) > 0 AS over_ FROM l JOIN o USING (lang, no_lang)),
e AS (SELECT lang, no_lang, step, count(*) FILTER (NOT proposes AND good) AS n, count(*) FILTER (NOT proposes AND good AND over_) AS k, count(*) FILTER (proposes AND NOT good AND over_) AS caught FROM j GROUP BY ALL),
b AS (SELECT *, n > 0 AND k < 0.02 * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.05 / (SELECT count(DISTINCT (lang, no_lang)) FROM o) AS fine FROM e),
s AS (SELECT *, bool_and(fine) OVER (PARTITION BY lang, no_lang ORDER BY step) AS certified FROM b),
h AS (SELECT lang, no_lang, arg_max(step, caught * 100 - step) AS step FROM s WHERE certified GROUP BY lang, no_lang),
z AS (SELECT lang, no_lang, x FROM h JOIN o USING (lang, no_lang, step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (x IS NULL OR len(list_filter(range(1, 8), lambda i: v[i] > x[i])) = 0) AS kept
FROM f LEFT JOIN z USING (lang, no_lang)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard": OP6_SQL, "op7_warc": OP7_SQL, "op10_vectors": OP10_SQL, "op13_quality": OP13_SQL}
