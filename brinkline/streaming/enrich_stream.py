"""The extractor as a stream: new record files in, enriched files out, exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans.enrich import enrich


def start(spark: SparkSession, source: str, target: str, checkpoint: str, settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """``once``: work off what is there and stop; else keep watching the folder."""
    records = spark.readStream.text(source).select(F.parse_json("value").alias("record"))
    writer = enrich(records, settings).select(F.col("json").alias("value")).writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
