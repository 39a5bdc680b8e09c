"""Rolling baselines against golden series and their streaming twin."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import baseline as B
from tidemark.streaming import scoring

SCHEMA = "vm_id string, metric_name string, timestamp timestamp_ntz, value double, seq long"


def series(spark, values, start="2025-11-10T03:00:00", step=dt.timedelta(days=7)):
    at = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([("vm", "cpu", at + i * step, float(v), i) for i, v in enumerate(values)], SCHEMA)


def scored(spark, values, **options):
    rows = B.score(B.with_buckets(series(spark, values), split_weekend=False), ["vm_id", "metric_name", "hour", "is_weekend"], **options)
    return sorted(rows.collect(), key=lambda r: r["seq"])


def test_outlier_after_stable_readings(spark):
    rows = scored(spark, [61, 62, 63, 62, 61, 62, 63, 61, 62, 63, 200])
    assert rows[-1]["is_anomaly"] and rows[-1]["z_score"] == pytest.approx(178.157, abs=1e-3)
    assert sum(r["cold_start"] for r in rows) == 5


def test_exactly_one_anomaly(spark):
    rows = scored(spark, [61, 62, 63, 62, 61, 62, 500])
    assert [r["is_anomaly"] for r in rows] == [False] * 6 + [True]
    assert rows[-1]["z_score"] == pytest.approx(637.63, abs=1e-2)


def test_threshold_is_strict_and_constant_windows_have_no_spread(spark):
    rows = scored(spark, [-1, 1] * 15 + [3])
    assert rows[-1]["z_score"] == pytest.approx(3.0) and not rows[-1]["is_anomaly"]
    assert scored(spark, [5] * 30 + [999])[-1]["z_score"] == 0.0
    assert scored(spark, [random.Random(1).uniform(0, 500) for _ in range(60)] + [7.1] * 30 + [7.2])[-1]["z_score"] == 0.0


def test_published_series(spark):
    draw = random.Random(42)
    values = [62 + draw.uniform(-3, 3) for _ in range(30)]
    rows = scored(spark, [*values, 150])
    past = np.array(values)
    assert rows[-1]["z_score"] == pytest.approx((150 - past.mean()) / past.std())


def test_window_and_state(spark):
    points = B.with_buckets(series(spark, [10, 20, 30, 40, 50, 60, 70]), split_weekend=False)
    state = B.final_state(points, ["vm_id", "metric_name"], window=5).first()
    assert (state["count"], state["window"]) == (5, [30.0, 40.0, 50.0, 60.0, 70.0])
    assert B.final_state(points, ["vm_id"], window=3).first()["mean"] == 60.0


def test_robust_mode_reports_moments_but_scores_by_median(spark):
    rows = scored(spark, [2, 4, 4, 4, 5, 5, 7, 9, 100], method="robust_zscore")
    assert rows[-1]["baseline_mean"] == 5.0 and rows[-1]["baseline_std"] == 2.0
    assert rows[-1]["z_score"] == pytest.approx(128.8295)
    with pytest.raises(ValueError):
        B.score(series(spark, [1]), ["vm_id"], method="other")


def test_not_seasonal_goes_to_one_bucket(spark):
    rows = B.with_buckets(series(spark, [1, 2], step=dt.timedelta(hours=15)), seasonal_if=B.seasonal(allow=["net"]))
    assert {(r["hour"], r["is_weekend"]) for r in rows.collect()} == {(None, None)}
    assert B.with_buckets(series(spark, [1]), seasonal_if=B.seasonal(allow=["cpu"], deny=["cpu"])).first()["hour"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=50))
def test_any_series_agrees_with_a_loop(spark, values):
    for i, r in enumerate(scored(spark, values)):
        past = np.array(values[max(0, i - 30) : i])
        assert r["n"] == len(past)
        if len(past):
            assert r["baseline_mean"] == pytest.approx(past.mean(), abs=1e-6, rel=1e-9)


def test_stream_equals_batch(spark, tmp_path):
    points = B.with_buckets(series(spark, [61, 62, 63, 62, 61, 62, 500, 62, 61]), split_weekend=False)
    rows = points.selectExpr("'b' AS bucket", "cast(timestamp as timestamp) AS timestamp", "seq", "value").coalesce(1)
    for part in range(3):  # three micro-batches
        rows.where(f"seq >= {3 * part} AND seq < {3 * part + 3}").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = scoring.run_to_end(scoring.score_stream(stream), f"{tmp_path}/state", "scored").collect()
    got = {r["seq"]: (r["n"], round(r["z_score"], 6), r["is_anomaly"]) for r in out}
    want = {r["seq"]: (r["n"], round(r["z_score"], 6), r["is_anomaly"]) for r in B.score(points, ["vm_id", "hour"]).collect()}
    assert got == want
