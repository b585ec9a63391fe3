"""Scored task records: scans, loads, samples and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES
from ..functions.status import variant_pass_rate
from ..operators.quantiles import smallest
from .scratch import folder as shared_folder

FEATURE_TYPE = "struct<" + ",".join(f"{f}:{'double' if f == 'inst_avg_word_len' else 'int'}" for f in FEATURES) + ">"
DEFAULTS = {"e_norm": ("double", 0.0), "m_mem_jaccard": ("double", 0.0), "coupling_depth": ("int", 0), "kappa_cyclomatic": ("double", 1.0)}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: one ``VARIANT`` per line; a malformed line fails the job."""
    return spark.read.text(path).select(F.parse_json("value").alias("record"))


def fields(record: Column) -> Column:
    return F.try_variant_get(record, "$", "map<string,variant>")


def field(record: Column, name: str, kind: str, default=None) -> Column:
    """A member of a record; the default stands for a missing key, not for a null."""
    value = F.try_variant_get(record, f"$.{name}", kind)
    return value if default is None else F.when(F.map_contains_key(fields(record), name), value).otherwise(F.lit(default).cast(kind))


def flat(records: DataFrame, columns: tuple[str, ...] = ("e_norm", "m_mem_jaccard", "coupling_depth"), mode: str = "load") -> DataFrame:
    """The analysis frame of enriched records: ten features, complexity, success, pass rate and the columns asked for."""
    r = F.col("record")
    features = F.try_variant_get(r, "$.iv_features", FEATURE_TYPE)
    stored = F.try_variant_get(r, "$.pass_rate", "double") if mode == "load" else None
    status = F.try_variant_get(r, "$.status", "variant")
    return records.select(
        field(r, "id", "string", "").alias("id"), *[features[f].alias(f) for f in FEATURES], field(r, "kappa_cyclomatic", "double", 1.0).alias("kappa_actual"), field(r, "is_success", "int", 0).alias("is_success"),
        variant_pass_rate(status, mode, stored).alias("pass_rate"), field(r, "lang", "string", "unknown").alias("lang"), *[field(r, c, *DEFAULTS[c]).alias(c) for c in columns],
    )


def load_stage1(spark: SparkSession, path: str) -> DataFrame:
    return flat(read_records(spark, path))


load_stage2 = load_stage1


def load_static_figures(spark: SparkSession, path: str) -> DataFrame:
    return flat(read_records(spark, path), ("e_norm",))


def load_interactive_figures(spark: SparkSession, path: str) -> DataFrame:
    return flat(read_records(spark, path), ("e_norm", "m_mem_jaccard"), "figure")


def read_proxy(spark: SparkSession, path: str) -> DataFrame:
    """``id, text``: a proxy corpus, one text a line; a missing file is an empty corpus."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], "id long, text string")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, those first by a hash of the key; all if there are fewer.

    The 60 leading bits of the hash decide; rows that share them with the last
    one, as rows of one key do, are taken in any order.  Nothing is sorted.
    """
    hash_ = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return smallest(df, F.conv(F.substring(hash_, 1, 15), 16, 10).cast("long"), n)


def sample_lines(spark: SparkSession, path: str, n: int = 2000, seed: int = 42) -> DataFrame:
    return exact_sample(spark.read.text(path), "value", n, seed)


def write_temporary(lines: DataFrame, folder: str | None = None) -> str:
    """Write sampled lines to a new place in a folder that driver and executors share, and return it.

    Without ``folder`` that is the session's ``spark.checkpoint.dir``; only a
    local session may have none, and then uses a temporary folder.
    """
    out = f"{folder or shared_folder(lines.sparkSession)}/sample-{uuid.uuid4().hex}"
    lines.write.mode("overwrite").text(out)
    return out


def write_jsonl(records: DataFrame, path: str, column: str = "json") -> None:
    records.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_summary(spark: SparkSession, facts: dict, path: str) -> DataFrame:
    """The result summary as one row, written as text lines ``name: value``."""
    lines = ["Stage 2 results", *[f"{k}: {v}" for k, v in facts.items()]]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in facts.values())], ", ".join(f"`{k}` string" for k in facts))
