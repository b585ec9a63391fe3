"""Enrichment: scored records in, records with features out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.code_metrics import gated_code_metrics
from ..functions.status import success, variant_pass_rate
from ..functions.text import instruction_features
from ..sources.tasks import DEFAULTS, field, fields, read_records, write_jsonl


def enrich(records: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Add features, pass rate, success, code metrics and defaults; other members pass through.

    Columns: ``record`` as read, the new values, and ``json``, the whole enriched object.
    """
    settings = settings or Settings()
    r = F.col("record")
    rate = variant_pass_rate(F.try_variant_get(r, "$.status", "variant"))
    out = records.withColumn("iv_features", instruction_features(field(r, "input", "string"), settings.lexicon)).withColumn("pass_rate", rate)
    out = out.withColumn("is_success", success(F.col("pass_rate"), settings.success_at))
    out = out.withColumn("ast_features", gated_code_metrics(field(r, "code_cleaned", "string"), field(r, "lang", "string")))
    new = {c: F.to_variant_object(F.struct(F.col(c).alias("v"))) for c in ("iv_features", "pass_rate", "is_success", "ast_features")}
    value = lambda c: F.variant_get(c, "$.v", "variant")
    missing = {k: F.to_variant_object(F.struct(F.lit(d).cast(kind).alias("v"))) for k, (kind, d) in DEFAULTS.items()}
    kept = F.map_filter(fields(r), lambda k, v: ~k.isin(*new))
    added = F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*map(value, new.values())))
    added = F.map_filter(added, lambda k, v: (k != "ast_features") | F.col("ast_features").isNotNull())
    filled = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, missing)), F.array(*map(value, missing.values()))), lambda k, v: ~F.map_contains_key(fields(r), k))
    return out.withColumn("json", F.to_json(F.map_concat(kept, filled, added)))


def run(spark: SparkSession, source: str, target: str, settings: Settings | None = None) -> None:
    write_jsonl(enrich(read_records(spark, source), settings), target)
