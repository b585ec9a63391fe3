"""The corpus pipeline: stages applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns all that it kept with its
decisions in effect; all but the last keep the columns of ``documents``.
Rows are told apart by a key of their own, not by ``doc_id``, so missing and
repeated ids lose nothing.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinkline.llm import decontaminate, jaccard, langid, pii, sentencepiece_nbest
from brinkline.llm.common import dropped, held_out, table, with_row_key, written
from brinkline.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.34


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go (``und``, which null texts and texts without a
    letter are, or a score near the even chance); a missing ``lang`` is filled in.

    Repeated rows stay as often as they are there; without any labelled text every document goes.
    """
    model = langid.fit(docs, train=~held_out())
    found = langid.predict(docs, model, keep=COLUMNS)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) that with the smallest id stays.

    Rows without id come after all ids; of equal ids the smaller row key stays.  Rows of one id whose
    texts are not linked all stay, and so do texts without words, which link with nothing.
    """
    rows = with_row_key(docs, "__row")
    found = jaccard.join(rows.select("__row", "text"), id_col="__row", size=5, percent=80)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    linked = found.join(found.filter("doc <> component_id").select("component_id").distinct(), "component_id").select(F.col("doc").alias("__row"), "component_id")
    linked = written(rows.select("__row", "doc_id").join(linked, "__row"), "linked")
    stay = linked.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = written(linked.join(stay, "__row", "left_anti").select("__row"), "copies")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, with or without id; null and empty texts and
    repeated rows without overlap stay."""
    rows = with_row_key(docs, "__row")
    found = decontaminate.overlaps(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
    gone = written(found.select(F.col("doc").alias("__row")).distinct(), "leaks")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind and ``n_chars`` counted anew; no document goes, null texts stay null."""
    found = pii.scan(docs, pii.fit(spark), keep=COLUMNS)
    text = pii.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; null texts have null pieces, empty ones none."""
    found = sentencepiece_nbest.encode(docs, piece_model(), keep=("doc_id", "lang", "source"), n=2, reuse=False)
    return found.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "score", "round_trip")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("private_data", private_data), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
