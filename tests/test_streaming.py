"""The streamed curve against the batch curve."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from brinkline.config import Settings
from brinkline.operators import threshold
from brinkline.streaming import curve_stream

SETTINGS = Settings(min_regime=20)
SCHEMA = "id string, at timestamp, k double, c double, y double"


def known(curve):
    return [-1.0 if f is None else f for f in curve]


def records(n, seed):
    rnd = random.Random(seed)
    day = dt.datetime(2026, 1, 1)
    out = []
    for i in range(n):
        k, c = rnd.uniform(0, 16), rnd.gauss(0, 1)
        out.append((f"r{i}", day + dt.timedelta(minutes=i), k if i % 17 else None, c, (k > 6.5) + 0.3 * c + rnd.gauss(0, 0.4)))
    return out


def test_curve_after_replays_and_late_rows(spark, tmp_path):
    """Files one trigger each, in the order of their names: rows, repeats of rows, rows that come late."""
    rows = records(600, 3)
    late = rows[100:140]
    files = [rows[:100] + rows[140:300], rows[250:300] * 2 + rows[300:450], late + rows[300:320], rows[450:] + late]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(i, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        curve_stream.start(stream, "y", "k", ["c"], "id", "at", target, str(tmp_path / "check"), delay="2 days", shift={"k": 8.0, "c": 0.0, "y": 0.5}, settings=SETTINGS).awaitTermination(120)
        return [r.f_stat for r in curve_stream.latest(spark, target).orderBy("gamma").collect()]

    arrived = set()
    for i, part in enumerate(files):
        put(i, part)
        got = run()  # a new query each time goes on from the state of the last
        arrived |= set(part)
        want = threshold.search(spark.createDataFrame(sorted(arrived), SCHEMA), "y", "k", ["c"], SETTINGS).curve
        assert known(got) == pytest.approx(known(want), rel=1e-7)


def test_rows_beyond_the_delay_are_left_out(spark, tmp_path):
    rows = records(300, 5)
    old = [("old", dt.datetime(2020, 1, 1), 3.0, 0.0, 50.0)]
    source, target = tmp_path / "in", str(tmp_path / "out")
    for i, part in enumerate((rows[:200], rows[200:], old)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        curve_stream.start(stream, "y", "k", [], "id", "at", target, str(tmp_path / "check"), delay="1 hour", settings=SETTINGS).awaitTermination(120)
    want = threshold.search(spark.createDataFrame(rows, SCHEMA), "y", "k", [], SETTINGS).curve
    assert known(r.f_stat for r in curve_stream.latest(spark, target).orderBy("gamma").collect()) == pytest.approx(known(want), rel=1e-7)
