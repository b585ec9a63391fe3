"""The threshold curve of a stream: moments by cell as state, a curve for each trigger.

Moments are sums, so Spark's streaming aggregation keeps them mergeable by
cell: its state is a row for each cell, whatever has arrived.  A record counts
once, however often it is sent, as long as its repeats arrive within ``delay``
of each other; rows later than that are left out by the watermark.  After each
trigger the curve of all that has arrived is written to a folder of its own,
so a repeated trigger replaces what it wrote.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.moments import all_numbers, centred
from ..operators.threshold import CURVE, cell_of, f_curve


def terms_of(kappa: str, controls: list[str], y: str, shift: dict[str, float]) -> list[Column]:
    return [F.lit(1.0), *[centred(c, shift) for c in (kappa, *controls, y)]]


def moment_stream(rows: DataFrame, y: str, kappa: str, controls: list[str], key: str, time: str, delay: str, shift: dict[str, float], settings: Settings) -> DataFrame:
    """``cell`` and ``s_i_j``, the sums of products of a constant, ``kappa``, the controls and ``y``, of
    distinct records.  ``shift`` are numbers near the columns' means, fixed for the life of the stream."""
    fresh = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    terms = terms_of(kappa, controls, y, shift)
    sums = [F.sum(terms[i] * terms[j]).alias(f"s_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    return fresh.filter(all_numbers([kappa, *controls, y])).groupBy(cell_of(F.col(kappa).cast("double"), settings.grid).alias("cell")).agg(*sums)


def curve_of(moments: DataFrame, size: int, settings: Settings) -> list[tuple[float, float | None]]:
    """(gamma, statistic) from the moments of the cells, at most a row for each."""
    cells = np.zeros((len(settings.grid) + 1, size, size))
    for row in moments.collect():
        for i in range(size):
            for j in range(i, size):
                cells[row["cell"], i, j] = cells[row["cell"], j, i] = row[f"s_{i}_{j}"]
    return list(zip(settings.grid, f_curve(list(cells), list(range(size - 1)), size - 1, settings.min_regime), strict=True))


def start(rows: DataFrame, y: str, kappa: str, controls: list[str], key: str, time: str, target: str, checkpoint: str, delay: str = "1 day", shift: dict[str, float] | None = None, settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """Write ``gamma, f_stat`` of each trigger to ``target/trigger=<n>``; ``once``: work off what is there and stop."""
    settings = settings or Settings()
    columns = [kappa, *controls, y]
    shift = shift or dict.fromkeys(columns, 0.0)
    moments = moment_stream(rows, y, kappa, controls, key, time, delay, shift, settings)

    def emit(batch: DataFrame, trigger: int) -> None:
        curve = curve_of(batch, len(columns) + 1, settings)
        batch.sparkSession.createDataFrame(curve, CURVE).coalesce(1).write.mode("overwrite").parquet(f"{target}/trigger={trigger}")

    writer = moments.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(emit)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark, target: str) -> DataFrame:
    """The curve of the last trigger."""
    curves = spark.read.option("basePath", target).parquet(target)
    last = curves.agg(F.max("trigger")).first()[0]
    return curves.filter(F.col("trigger") == last).select("gamma", "f_stat")
