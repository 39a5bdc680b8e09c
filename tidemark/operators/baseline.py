"""Rolling per-bucket baselines and z-scores.

A bucket is a key and, for seasonal metrics, an hour block and a side of the week. A reading is scored against the last
``window`` readings of its bucket, itself left out; so state and score need no loop, only a window frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X


def seasonal(metric: str = "metric_name", allow: list[str] | None = None, deny: list[str] | None = None):
    """Denied metrics are not seasonal; if some are allowed only these are; else all."""
    if deny:
        return F.when(F.col(metric).isin(deny), False).otherwise(F.col(metric).isin(allow) if allow is not None else F.lit(True))
    return F.col(metric).isin(allow) if allow is not None else F.lit(True)


def with_buckets(points: DataFrame, hours: int = C.BUCKET_HOURS, split_weekend: bool = C.SPLIT_WEEKEND, seasonal_if=None) -> DataFrame:
    """Add ``hour`` and ``is_weekend``; both null for the global bucket of a metric that is not seasonal."""
    season = F.lit(True) if seasonal_if is None else seasonal_if
    weekend = X.is_weekend(F.col("timestamp")) if split_weekend else F.lit(None).cast("boolean")
    return points.withColumns({"hour": F.when(season, X.hour_block(F.col("timestamp"), hours)), "is_weekend": F.when(season, weekend)})


def score(points: DataFrame, keys: list[str], method: str = "zscore", window: int = C.WINDOW_SAMPLES, threshold: float = C.Z_THRESHOLD, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """Add n, baseline_mean, baseline_std, z_score, cold_start, is_anomaly, by arrival in (timestamp, seq)."""
    if method not in ("zscore", "robust_zscore"):
        raise ValueError(f"unknown method {method}")
    frame = Window.partitionBy(*keys).orderBy("timestamp", "seq").rowsBetween(-window, -1)
    v = F.col("value")
    # A constant frame has no spread, whatever rounding a running sum would leave.
    std = F.when(F.min(v).over(frame) == F.max(v).over(frame), 0.0).otherwise(F.coalesce(F.stddev_pop(v).over(frame), F.lit(0.0)))
    added = {"n": F.count(v).over(frame), "baseline_mean": F.coalesce(F.avg(v).over(frame), F.lit(0.0)), "baseline_std": std}
    if method == "robust_zscore":
        added["__w"] = F.collect_list(v).over(frame)
    out = points.withColumns(added)
    if method == "robust_zscore":
        # The median is materialised before the deviations are taken, or it would be evaluated for each element.
        out = out.withColumn("__med", X.middle(F.array_sort("__w")))
        out = out.withColumn("__dev", F.array_sort(F.transform("__w", lambda x: F.abs(x - F.col("__med")))))
        z = X.robust_z(v, F.col("__med"), X.middle(F.col("__dev")))
    else:
        z = X.z_score(v, F.col("baseline_mean"), F.col("baseline_std"))
    out = out.withColumn("cold_start", F.col("n") < min_samples)
    out = out.withColumn("z_score", F.when(F.col("cold_start"), 0.0).otherwise(z))
    # Strictly above; a score that only rounding has put above is at the threshold.
    return out.withColumn("is_anomaly", F.abs("z_score") > threshold * (1 + 1e-12)).drop("__w", "__med", "__dev")


def final_state(points: DataFrame, keys: list[str], window: int = C.WINDOW_SAMPLES) -> DataFrame:
    """The last state of each bucket: count, mean, std and its readings in order."""
    last = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("seq"))
    kept = points.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= window)
    std = F.when(F.min("value") == F.max("value"), 0.0).otherwise(F.stddev_pop("value"))
    readings = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "seq", "value"))), lambda r: r["value"])
    return kept.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), std.alias("std"), readings.alias("window"))


def decayed(points: DataFrame, keys: list[str], alpha: float, window: int = C.WINDOW_SAMPLES) -> DataFrame:
    """Add ``decayed_mean``: the readings before, weighted (1 - alpha) to the power of their age."""
    frame = Window.partitionBy(*keys).orderBy("timestamp", "seq").rowsBetween(-window, -1)
    held = F.reverse(F.collect_list("value").over(frame))
    weigh = lambda x, i: x * F.pow(F.lit(1 - alpha), i)
    total = F.aggregate(F.transform(held, lambda x, i: F.pow(F.lit(1 - alpha), i)), F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("decayed_mean", F.try_divide(F.aggregate(F.transform(held, weigh), F.lit(0.0), lambda s, x: s + x), total))


def counters(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("processed"), F.count_if("is_anomaly").alias("anomalies"), F.count_if("cold_start").alias("cold"))


STATE = "struct<count:bigint,mean:double,std:double,window:array<double>>"


def state_json(state: DataFrame) -> DataFrame:
    """Bucket states as one JSON column ``state`` beside their keys."""
    fields = ["count", "mean", "std", "window"]
    return state.select(*[c for c in state.columns if c not in fields], F.to_json(F.struct(*fields)).alias("state"))


def state_of(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`state_json`; a missing state is an empty bucket."""
    held = F.from_json("state", STATE)
    parts = {"count": F.coalesce(held["count"], F.lit(0)), "mean": F.coalesce(held["mean"], F.lit(0.0)), "std": F.coalesce(held["std"], F.lit(0.0)), "window": F.coalesce(held["window"], F.array().cast("array<double>"))}
    return rows.withColumns(parts).drop("state")
