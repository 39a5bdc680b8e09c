"""Corpus synthesis: hourly seeds to minutes, injected anomalies, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.functions import exprs as X


def linear_fill(values: Column) -> Column:
    """An array of 24 hours: longer ones cut, gaps on a line between their neighbours, ends held."""
    day = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get(values, h).cast("double"))
    known = F.filter(F.transform(day, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]))

    def fill(v: Column, i: Column) -> Column:
        before = F.element_at(F.filter(known, lambda x: x["i"] <= i), -1)
        after = F.get(F.filter(known, lambda x: x["i"] >= i), F.lit(0))
        first, last = F.get(known, F.lit(0)), F.element_at(known, -1)
        part = (i - before["i"]) / (after["i"] - before["i"]).cast("double")
        inner = F.when(before["i"] == after["i"], before["v"]).otherwise(before["v"] + (after["v"] - before["v"]) * part)
        return F.when(F.size(known) == 0, F.lit(None).cast("double")).when(i <= first["i"], first["v"]).when(i >= last["i"], last["v"]).otherwise(inner)

    return F.transform(day, fill)


def filled_hours(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("hours", linear_fill(F.col("hourly_values")))


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interpolating cubic spline whose third derivative is continuous at the second and last but one knot.

    Solved for the second derivatives at the knots.
    """
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * right + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * left


def minutes(seeds: DataFrame, noise: float = C.NOISE_FRACTION, seed: int = 42) -> DataFrame:
    """One row a minute of each seed's day, by a spline through the hours that wraps at midnight, with seeded noise.

    The spline is the one step that needs Python: its knots are fixed, so all curves of a batch are one product with the
    curves of the unit vectors. Rows are spread out in the JVM.
    """
    keep = [c for c in seeds.columns if c != "hourly_values"]
    rows = filled_hours(seeds).where(F.get("hours", F.lit(0)).isNotNull())
    schema = T.StructType([*(f for f in rows.schema if f.name != "hourly_values"), T.StructField("curve", T.ArrayType(T.DoubleType()))])

    def spline(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        knots, at = np.arange(-1.0, 25.0), np.arange(1440) / 60.0
        units = np.array([not_a_knot(knots, y, at) for y in np.eye(len(knots))])
        for f in frames:
            hours = np.array(f["hours"].tolist(), float).reshape(len(f), 24)
            f["curve"] = list(np.concatenate([hours[:, -1:], hours, hours[:, :1]], axis=1) @ units)
            yield f

    rows = rows.select(*keep, "hours").mapInPandas(spline, schema)
    positive = F.filter("hours", lambda x: x > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda s, x: s + x) / F.size(positive)).otherwise(1.0)
    rows = rows.select(*keep, "hours", mean.alias("__mean"), F.posexplode("curve").alias("minute", "value"))
    draw = lambda k: X.unit_draw(F.lit(seed + k), F.col("entity_id"), F.col("metric_name"), F.col("date"), F.col("minute"))
    normal = F.sqrt(-2 * F.ln(1 - draw(0))) * F.cos(F.lit(6.283185307179586) * draw(1))
    value = F.col("value") + (normal * F.col("__mean") * noise if noise else F.lit(0.0))
    return rows.select(
        *[c for c in keep if c != "date"], F.col("date"), F.timestamp_add("MINUTE", "minute", F.col("date")).alias("timestamp"), F.greatest(F.lit(0.0), value).alias("value"),
        F.get("hours", F.floor(F.col("minute") / 60).cast("int")).alias("hour_anchor"), X.weekday(F.col("date")).alias("day_of_week"),
        F.floor(F.col("minute") / 60).cast("int").alias("hour_of_day"), (F.col("minute") % 60).alias("minute_of_hour"),
    )


def anchor_effects(anchors: DataFrame, seed: int = 42) -> DataFrame:
    """Add each anchor's half width in minutes, factor and order, drawn from its own keys."""
    draw = lambda k: X.unit_draw(F.lit(seed + k), F.col("entity_id"), F.col("alert_ts"), F.col("anomaly_type"))
    lo, hi = C.ANOMALY_MINUTES
    between = lambda pair, k: pair[0] + (pair[1] - pair[0]) * draw(k)
    factor = F.when(F.col("anomaly_type") == "spike", between(C.SPIKE, 1)).otherwise(between(C.DROP, 1))
    return anchors.withColumns({"half": F.floor((lo + F.floor((hi - lo) * draw(0))) / 2).cast("int"), "factor": factor})


def inject(rows: DataFrame, effects: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Multiply values near anchors; factors of overlapping anchors multiply, the last one names the type.

    ``rows`` are (entity_id, timestamp, value, ..); an anchor counts on its own day only. Anchors are gathered by
    entity and day, so the range condition is a filter on an array and each row stays one row.
    """
    order = order or ["alert_ts", "anomaly_type"]
    near = effects.withColumn("__day", F.date_trunc("DAY", "alert_ts"))
    anchor = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("alert_ts"), F.col("half"), F.col("factor"), F.col("anomaly_type"))
    near = near.groupBy("entity_id", "__day").agg(F.array_sort(F.collect_list(anchor)).alias("__anchors"))
    out = rows.withColumn("__day", F.date_trunc("DAY", "timestamp")).join(near, ["entity_id", "__day"], "left")
    minutes_off = lambda a: F.abs(F.timestamp_diff("SECOND", a["alert_ts"], F.col("timestamp"))) <= a["half"] * 60
    out = out.withColumn("__hit", F.filter("__anchors", minutes_off))
    product = F.aggregate("__hit", F.lit(1.0), lambda p, a: p * a["factor"])
    hit = F.coalesce(F.size("__hit") > 0, F.lit(False)) & F.col("__hit").isNotNull()
    return out.withColumns({
        "value": F.when(hit, F.col("value") * product).otherwise(F.col("value")), "is_anomaly": hit,
        "anomaly_type": F.when(hit, F.element_at("__hit", -1)["anomaly_type"]).otherwise(""),
    }).drop("__day", "__anchors", "__hit")


def build(seeds: DataFrame, anchors: DataFrame, noise: float = C.NOISE_FRACTION, seed: int = 42) -> DataFrame:
    """The minute corpus, in its fixed column order."""
    return inject(minutes(seeds, noise, seed), anchor_effects(anchors, seed)).select(*C.CORPUS_COLUMNS)


def summary(corpus: DataFrame) -> DataFrame:
    """One row: counts, anomalies, period."""
    return corpus.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("entity_id").alias("unique_entities"), F.count_distinct("metric_name").alias("unique_metrics"),
        F.count_if("is_anomaly").alias("anomaly_rows"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_fraction"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.avg((F.col("cloud") == "Unknown").cast("double")).alias("unknown_cloud"),
    )


def pair_integrity(pairs: DataFrame) -> DataFrame:
    """(pair_id, n, ok): exactly one row of each view."""
    out = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("view")).alias("views"))
    return out.select("pair_id", "n", ((F.col("n") == 2) & (F.array_join("views", ",") == "a,b")).alias("ok"))


def pair_offsets(pairs: DataFrame) -> DataFrame:
    """(pair_id, seconds) between the two views."""
    one = lambda v: pairs.where(F.col("view") == v).select("pair_id", F.col("timestamp").alias(f"ts_{v}"))
    return one("a").join(one("b"), "pair_id").select("pair_id", F.abs(F.timestamp_diff("SECOND", F.col("ts_a"), F.col("ts_b"))).alias("seconds"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, distinct) of each column, in one pass over the data."""
    sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct")) for c in columns])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def outside(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """(values): those of a column that are not allowed."""
    return df.agg(F.array_sort(F.array_except(F.collect_set(column), F.array(*map(F.lit, allowed)))).alias("values"))


def hour_gaps(corpus: DataFrame) -> DataFrame:
    """(entity_id, metric_name, gaps): hours without a row between an entity's first and last."""
    hours = corpus.select("entity_id", "metric_name", F.date_trunc("HOUR", "timestamp").alias("h")).distinct()
    before = F.lag("h").over(Window.partitionBy("entity_id", "metric_name").orderBy("h"))
    return hours.withColumn("__b", before).groupBy("entity_id", "metric_name").agg(F.sum(F.greatest(F.lit(0), F.timestamp_diff("HOUR", F.col("__b"), F.col("h")) - 1)).alias("gaps"))
