"""Sequences of an entity's events: last L, tumbling and sliding count windows, matched views, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C

ORDER = ["timestamp", "metric_name", "seq"]


def last_events(records: DataFrame, length: int = C.SEQUENCE, key: str = "entity_id", order: list[str] = ORDER) -> DataFrame:
    """The last ``length`` events of each entity with ``pos`` from 0 in ascending order."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = records.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= length)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).drop("__back")


def first_events(records: DataFrame, n: int, key: str = "entity_id", order: list[str] = ORDER) -> DataFrame:
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def tumbling(records: DataFrame, length: int = C.SEQUENCE, key: str = "entity_id", order: list[str] = ORDER) -> DataFrame:
    """Add ``window_id`` and ``pos`` of windows of ``length`` events that do not overlap; the last may be short."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    out = records.withColumn("__rn", rn)
    return out.withColumns({"window_id": F.floor(F.col("__rn") / length), "pos": F.col("__rn") % length}).drop("__rn")


def _starts(rn: Column, n: Column, length: int, stride: int) -> Column:
    """Starts of the full windows that hold place ``rn`` (from 0) of ``n``; null if there is none."""
    low = F.greatest(F.lit(0), F.ceil((rn - length + 1) / stride) * stride)
    high = F.least(F.floor(rn / stride) * stride, F.floor((n - length) / stride) * stride)
    return F.when((n >= length) & (low <= high), F.sequence(low.cast("long"), high.cast("long"), F.lit(stride).cast("long")))


def sliding(records: DataFrame, length: int = C.SEQUENCE, stride: int = C.STRIDE, key: str = "entity_id", order: list[str] = ORDER) -> DataFrame:
    """Rows of full sliding windows, with ``window_start`` and ``pos``; a row is in ceil(length / stride) windows at most.

    Candidate starts follow from a row's number, so there is no range join.
    """
    per_key = Window.partitionBy(key)
    out = records.withColumns({"__rn": F.row_number().over(per_key.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(per_key)})
    out = out.withColumn("window_start", F.explode(_starts(F.col("__rn"), F.col("__n"), length, stride)))
    return out.withColumn("pos", F.col("__rn") - F.col("window_start")).drop("__rn", "__n")


def pair_windows(pairs: DataFrame, length: int = C.SEQUENCE, stride: int = C.STRIDE, key: str = "entity_id") -> DataFrame:
    """Windows of both views matched by place: (key, window_start, pos, pair_id_a, value_a, pair_id_b, value_b).

    Entities need both views; the shorter view limits the windows.
    """
    order = ["pair_id", "timestamp", "metric_name"]
    views = []
    for view in ("a", "b"):
        rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
        views.append(pairs.where(F.col("view") == view).select(key, rn.alias("__rn"), F.col("pair_id").alias(f"pair_id_{view}"), F.col("value").alias(f"value_{view}")))
    both = views[0].join(views[1], [key, "__rn"])  # places 0 to min(n_a, n_b) - 1
    both = both.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    both = both.withColumn("window_start", F.explode(_starts(F.col("__rn"), F.col("__n"), length, stride)))
    return both.withColumn("pos", F.col("__rn") - F.col("window_start")).drop("__rn", "__n")


def as_sequences(encoded: DataFrame, group: list[str], order: str = "pos") -> DataFrame:
    """One row a group: (group, steps, length), steps being structs of num, cat and ts in order."""
    num = F.array(*[F.col(c).cast("float") for c in ("value_norm", "hour_of_day", "day_of_week")])
    cat = F.array(*[F.col(f"{c}_idx").cast("int") for c in C.CATEGORICAL])
    step = F.struct(F.col(order).alias("at"), num.alias("num"), cat.alias("cat"), F.col("hour_frac").cast("float").alias("ts"))
    out = encoded.groupBy(*group).agg(F.array_sort(F.collect_list(step)).alias("__s"))
    bare = F.transform("__s", lambda x: F.struct(x["num"].alias("num"), x["cat"].alias("cat"), x["ts"].alias("ts")))
    return out.select(*group, bare.alias("steps"), F.size("__s").alias("length"))


def padded(sequences: DataFrame, length: int) -> DataFrame:
    """Steps filled with zeros up to ``length``."""
    zero = F.struct(F.array(*[F.lit(0.0).cast("float")] * 3).alias("num"), F.array(*[F.lit(0)] * 4).alias("cat"), F.lit(0.0).cast("float").alias("ts"))
    return sequences.withColumn("steps", F.concat("steps", F.array_repeat(zero, F.greatest(F.lit(0), F.lit(length) - F.col("length")))))


def shuffled(windows: DataFrame, group: list[str], seed: int = 0) -> DataFrame:
    """Windows in a seeded random order, each kept together."""
    return windows.orderBy(F.xxhash64(F.lit(seed), *group), *group, "pos")
