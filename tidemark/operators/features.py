"""Vocabularies, per-metric statistics and encoded records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X


def vocabulary(records: DataFrame, columns: list[str] = C.CATEGORICAL) -> DataFrame:
    """(column, label, idx): labels by code point from 1; null is no label, the empty string is. One scan for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns])).alias("p")
    labels = records.select(pairs).select("p.*").where(F.col("label").isNotNull()).distinct()
    return labels.withColumn("idx", F.row_number().over(Window.partitionBy("column").orderBy("label")))


def metric_stats(records: DataFrame) -> DataFrame:
    """(metric_name, mean, std) over values with null and NaN as 0; std is 1e-6 at least."""
    v = X.finite_or_zero(F.col("value"))
    rows = records.where(F.col("metric_name").isNotNull()).groupBy("metric_name")
    return rows.agg(F.avg(v).alias("mean"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias("std"))


def sample_stats(records: DataFrame) -> DataFrame:
    """(metric_name, mean, std) by sample deviation; an undefined or tiny one is 1."""
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    rows = records.groupBy("metric_name").agg(F.avg("value").alias("mean"), std.alias("std"))
    return rows.withColumn("std", F.when(F.col("std") <= 1e-6, 1.0).otherwise(F.col("std")))


def encode(records: DataFrame, vocab: DataFrame, stats: DataFrame, columns: list[str] = C.CATEGORICAL) -> DataFrame:
    """Add ``<column>_idx`` (0 for unknown labels), ``value_norm``, ``hour_frac``, ``hour_of_day`` and ``day_of_week``.

    Vocabularies and statistics are dimension tables; Spark broadcasts them if they are small enough.
    """
    out = records
    for c in columns:
        labels = vocab.where(F.col("column") == c).select(F.col("label").alias(c), F.col("idx").alias(f"{c}_idx"))
        out = out.join(labels, c, "left").withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(0)))
    out = out.join(stats.select("metric_name", F.col("mean").alias("__mean"), F.col("std").alias("__std")), "metric_name", "left")
    norm = X.value_norm(F.col("value"), F.coalesce("__mean", F.lit(0.0)), F.coalesce("__std", F.lit(1.0)))
    ts = F.col("timestamp")
    return out.withColumns({
        "value_norm": norm, "hour_frac": X.fractional_hour(ts) / F.lit(24.0), "hour_of_day": F.hour(ts) / F.lit(24.0), "day_of_week": X.weekday(ts) / F.lit(7.0),
    }).drop("__mean", "__std")


def unknown_counts(encoded: DataFrame, columns: list[str] = C.CATEGORICAL) -> DataFrame:
    """(column, oov) of labels that the vocabulary lacks."""
    sums = encoded.agg(*[F.count_if(F.col(f"{c}_idx") == 0).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("oov")) for c in columns])).alias("x")).select("x.*")
