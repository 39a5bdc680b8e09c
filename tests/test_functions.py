"""Scalar expressions against hand-computed values."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def test_hour_blocks(spark):
    assert one(spark, X.hour_block(stamp("2025-11-10 15:30:00"))) == 15
    assert {one(spark, X.hour_block(stamp(f"2025-11-10 {h}:00:00"), 4)) for h in (12, 13, 14, 15)} == {3}
    with pytest.raises(ValueError):
        X.hour_block(stamp("2025-11-10 15:30:00"), 5)


def test_weekend(spark):
    assert one(spark, X.is_weekend(stamp("2025-11-10 00:00:00"))) is False
    assert one(spark, X.is_weekend(stamp("2025-11-15 00:00:00"))) is True


def test_median_and_mad(spark):
    med, mad = X.median_and_mad(F.array(*[F.lit(float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)]))
    assert one(spark, med) == 4.5
    assert one(spark, mad) == 0.5
    assert one(spark, X.robust_z(F.lit(100.0), med, mad)) == pytest.approx(128.8295)
    empty = F.array().cast("array<double>")
    assert [one(spark, c) for c in X.median_and_mad(empty)] == [0.0, 0.0]


def test_z_without_spread_is_zero(spark):
    assert one(spark, X.z_score(F.lit(999.0), F.lit(5.0), F.lit(0.0))) == 0.0
    assert one(spark, X.z_score(F.lit(85.0), F.lit(62.0), F.lit(3.0))) == pytest.approx(7.6667, abs=1e-4)


def test_value_norm(spark):
    for v, want in ((60.0, 0.9999999), (50.0, 0.0), (float("nan"), -4.9999995), (None, -4.9999995)):
        assert one(spark, X.value_norm(F.lit(v).cast("double"), F.lit(50.0), F.lit(10.0))) == pytest.approx(want, abs=1e-7)


def test_time_features(spark):
    assert one(spark, X.fractional_hour(stamp("2025-11-11 06:30:00"))) == 6.5
    t = one(spark, X.time2vec(F.lit(6.0)))
    assert t[:2] == [6.0, pytest.approx(1.0)] and len(t) == 8


def test_vectors(spark):
    a, b, c = (F.array(*[F.lit(x) for x in v]) for v in ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]))
    similarity = lambda x, y: one(spark, X.cosine_from_squared(X.squared_distance(x, y)))
    assert (similarity(a, a), similarity(a, b), similarity(a, c)) == (1.0, 0.0, -1.0)
    assert one(spark, X.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, X.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_state_keys(spark):
    key = lambda h, w: one(spark, X.state_key(F.lit("vm-042"), F.lit("cpu_usage"), F.lit(h).cast("int"), F.lit(w).cast("boolean")))
    assert key(3, False) == "phase0:baseline:vm-042:cpu_usage:hour03:weekday"
    assert key(None, None) == "phase0:baseline:vm-042:cpu_usage:global"
    assert key(3, None) == "phase0:baseline:vm-042:cpu_usage:hour03"


@pytest.mark.parametrize(("rid", "ns", "want"), [("i-1", "", "AWS"), ("ocid1.x", "", "OCI"), ("/subscriptions/1", "", "Azure"), ("projects/p", "", "GCP"), ("x", None, "Unknown"), ("i-1", "Microsoft.X", "AWS")])
def test_cloud(spark, rid, ns, want):
    none = F.lit(None).cast("string")
    assert one(spark, X.cloud(F.lit(ns).cast("string"), F.lit(rid), none, none, none)) == want


def test_hourly_values_skip_zero_averages(spark):
    maps = F.expr("array(map('Average', 0D, 'average', 2D), map('Average', 0D, 'Sum', 0D), map('Sum', 5D), cast(null as map<string,double>))")
    assert one(spark, X.hourly_values(maps)) == [2.0, 0.0, 5.0, None]


def test_small_helpers():
    assert [X.embed_dim(v) for v in (4, 21, 127)] == [4, 10, 32]
    assert [X.cells_for(n) for n in (10, 390, 100_000)] == [1, 10, 100]
    assert math.isclose(sum([0.4, 0.4, 0.2]), 1.0)
    assert dt.date(2025, 11, 10).weekday() == 0
