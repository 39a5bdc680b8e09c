"""Deviation, drift, graded scores, deduplication, correlation, escalation and alert payloads."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.functions.graph import components


def deviation(current: DataFrame, profiles: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, global_deviation, local_deviation, deviation, flags): cosine distance to the centroid and to the history.

    Without a centroid both are 0.5.
    """
    rows = current.select(key, "embedding").join(profiles.select(key, "centroid", "history"), key, "left")
    whole = F.coalesce(F.lit(1.0) - X.dot(F.col("embedding"), F.col("centroid")), F.lit(0.5))
    each = F.transform("history", lambda h: F.lit(1.0) - X.dot(F.col("embedding"), h))
    local = F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.size("history"))
    rows = rows.withColumns({"global_deviation": whole, "local_deviation": F.coalesce(local, whole)})
    return rows.select(
        key, "global_deviation", "local_deviation", F.greatest("global_deviation", "local_deviation").alias("deviation"),
        (F.col("global_deviation") > C.GLOBAL_THRESHOLD).alias("global_flag"), (F.col("local_deviation") > C.LOCAL_THRESHOLD).alias("local_flag"),
    )


def mmd(samples: DataFrame, key: str = "entity_id", cap: int = 200) -> DataFrame:
    """(key, sigma, mmd2): unbiased kernel distance of ``side`` 'now' to side 'past', samples (key, side, id, embedding).

    At most ``cap`` vectors a side, the last by id, which is the statistic's own definition; so pairs of an entity are
    bounded. sigma is the median distance of all pairs over the root of 2.
    """
    last = Window.partitionBy(key, "side").orderBy(F.desc("id"))
    rows = samples.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= cap).select(key, "side", "id", "embedding")
    other = rows.select(key, F.col("side").alias("side2"), F.col("id").alias("id2"), F.col("embedding").alias("e2"))
    pairs = rows.join(other, key).where((F.col("side") < F.col("side2")) | ((F.col("side") == F.col("side2")) & (F.col("id") < F.col("id2"))))
    pairs = pairs.select(key, "side", "side2", X.squared_distance(F.col("embedding"), F.col("e2")).alias("d"))
    sigma = pairs.groupBy(key).agg((F.median(F.sqrt("d")) / F.sqrt(F.lit(2.0))).alias("sigma"))
    kernel = F.exp(-F.col("d") / (2 * F.col("sigma") * F.col("sigma")))
    mean = lambda a, b: F.avg(F.when((F.col("side") == a) & (F.col("side2") == b), kernel))
    out = pairs.join(sigma, key).groupBy(key).agg(F.first("sigma").alias("sigma"), (mean("now", "now") + mean("past", "past") - 2 * mean("now", "past")).alias("mmd2"))
    return out


def mmd_null(past: DataFrame, key: str = "entity_id", cap: int = 200, pairs: int = 1000, seed: int = 42) -> DataFrame:
    """(key, draw, mmd2): the statistic between ``pairs`` random halves of an entity's own past, so of one distribution.

    ``past`` is (key, id, embedding); the last ``2 * cap`` vectors by id of each entity are used, which bounds a group.
    An entity of fewer than four has no null.
    """
    last = Window.partitionBy(key).orderBy(F.desc("id"))
    rows = past.withColumns({"__n": F.row_number().over(last), "__all": F.count(F.lit(1)).over(Window.partitionBy(key))})
    rows = rows.where((F.col("__n") <= 2 * cap) & (F.col("__all") >= 4)).select(key, "id", "embedding")

    def draws(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x = np.array(group["embedding"].tolist(), float)
        n, half = len(x), len(x) // 2
        d = np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
        sigma = np.median(np.sqrt(d[np.triu_indices(n, 1)])) / np.sqrt(2)
        kernel = np.exp(-d / (2 * sigma * sigma)) if sigma > 0 else np.ones_like(d)
        np.fill_diagonal(kernel, 0)
        draw = np.random.default_rng(seed)
        order = np.argsort(draw.random((pairs, n)), axis=1)
        sides = np.zeros((pairs, n))
        np.put_along_axis(sides, order[:, :half], 1, axis=1)
        other = np.zeros((pairs, n))
        np.put_along_axis(other, order[:, half : 2 * half], 1, axis=1)
        of = lambda a, b: np.einsum("ij,ij->i", a @ kernel, b)
        within = half * (half - 1)
        return pd.DataFrame({key: group[key].iloc[0], "draw": np.arange(pairs), "mmd2": (of(sides, sides) + of(other, other)) / within - 2 * of(sides, other) / half**2})

    kind = past.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(draws, f"{key} {kind}, draw int, mmd2 double")


def drift_score(mmds: DataFrame, null: DataFrame, key: str = "entity_id") -> DataFrame:
    """Scale mmd2 by the 99th percentile of a null distribution (key, mmd2), clamp to [0, 1], flag above 0.5."""
    top = null.groupBy(key).agg(F.percentile("mmd2", 0.99).alias("__top"))
    rows = mmds.join(top, key, "left")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide("mmd2", "__top"), F.lit(0.5))))
    return rows.withColumns({"drift": score, "drift_flag": score > C.DRIFT_THRESHOLD}).drop("__top")


def final_score(dev: Column, drift: Column, similarity: Column) -> Column:
    """Weighted; a missing drift is 0.5, a missing similarity 0."""
    return C.W_DEVIATION * dev + C.W_DRIFT * F.coalesce(drift, F.lit(0.5)) + C.W_SIMILARITY * (1 - F.coalesce(similarity, F.lit(0.0)))


def severity(score: Column) -> Column:
    return F.when(score < C.MEDIUM, "LOW").when(score < C.HIGH, "MEDIUM").when(score < C.CRITICAL, "HIGH").otherwise("CRITICAL")


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def deduplicate(alerts: DataFrame, keys: list[str], ts: str = "timestamp", order: str = "seq", seconds: int = 300) -> DataFrame:
    """First alert of each fingerprint in each epoch-aligned bucket, with ``recurrence_count``."""
    rows = alerts.withColumns({"fingerprint": fingerprint(*[F.col(k).cast("string") for k in keys]), "bucket": F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)})
    per = Window.partitionBy("fingerprint", "bucket")
    rows = rows.withColumns({"recurrence_count": F.count(F.lit(1)).over(per), "__n": F.row_number().over(per.orderBy(ts, order))})
    return rows.where(F.col("__n") == 1).drop("__n")


def active(alerts: DataFrame, as_of: Column, key: str = "entity_id", ts: str = "timestamp", idle_minutes: int = 30) -> DataFrame:
    """Alerts up to ``as_of`` of entities whose last one is at most ``idle_minutes`` old; idle entities are pruned."""
    seen = alerts.where(F.col(ts) <= as_of)
    last = seen.groupBy(key).agg(F.max(ts).alias("__last")).where(F.timestamp_diff("MICROSECOND", F.col("__last"), as_of) <= idle_minutes * 60_000_000)
    return seen.join(last.select(key), key, "left_semi")


def correlate(alerts: DataFrame, attributes: list[str], key: str = "entity_id", ts: str = "timestamp", minutes: int = 10, shared: int = 2) -> DataFrame:
    """(node, label): groups of entities that share ``shared`` attributes and alert within ``minutes`` of each other.

    Entities meet through combinations of attribute values. An alert is linked to the one before it in such a combination
    only, which joins the same groups as all pairs would: two alerts in reach have only alerts in reach of each other
    between them. A combination is cut into time slots of ``minutes``, so none is one task's work: the one before is in
    the same slot, or it is the last of the slot before, as beyond an empty slot nothing is in reach.
    """
    combos = F.array(*[F.concat_ws("|", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in c]) for c in combinations(sorted(attributes), shared)])
    micros, slot = F.unix_micros(F.col(ts).cast("timestamp")), minutes * 60_000_000
    rows = alerts.select(key, micros.alias("t"), F.explode(combos).alias("combo")).withColumn("slot", F.floor(F.col("t") / slot))
    before = Window.partitionBy("combo", "slot").orderBy("t", key)
    inside = rows.select(F.lag(key).over(before).alias("a"), F.col(key).alias("b"))
    ends = rows.groupBy("combo", "slot").agg(F.min(F.struct("t", F.col(key).alias("e"))).alias("first"), F.max(F.struct("t", F.col(key).alias("e"))).alias("last"))
    next_ = ends.select("combo", (F.col("slot") - 1).alias("slot"), F.col("first").alias("next"))
    across = ends.join(next_, ["combo", "slot"]).where(F.col("next.t") - F.col("last.t") <= slot)
    links = inside.unionByName(across.select(F.col("last.e").alias("a"), F.col("next.e").alias("b")))
    return components(links.where("a <> b").distinct())


def regional(groups: DataFrame, regions: DataFrame, key: str = "entity_id", more_than: int = 10) -> DataFrame:
    """(label, region, entities, is_regional): a group with more than ``more_than`` entities of one region."""
    rows = groups.join(regions.select(F.col(key).alias("node"), "region").distinct(), "node").groupBy("label", "region").agg(F.count_distinct("node").alias("entities"))
    return rows.withColumn("is_regional", F.col("entities") > more_than)


def sev_level(criticality: Column, severity: Column, group: Column) -> Column:
    """1 to 4 by the severity matrix: the alert's severity, raised by one for a critical entity or a regional group.

    A low alert of a usual entity is 4, a critical one 1; a null criticality or group raises nothing.
    """
    base = F.when(severity == "CRITICAL", 1).when(severity == "HIGH", 2).when(severity == "MEDIUM", 3).otherwise(4)
    raised = F.coalesce((criticality == "critical").cast("int"), F.lit(0)) + F.coalesce((group == "REGIONAL_OUTAGE").cast("int"), F.lit(0))
    return F.greatest(F.lit(1), base - F.least(F.lit(1), raised))


def notify_method(level: Column, is_quiet: Column) -> Column:
    """Level 1 pages always; 2 pages and 3 writes, but both only post in quiet hours; 4 only posts."""
    return F.when(level == 1, "page").when(is_quiet | (level >= 4), "post").when(level == 2, "page").otherwise("mail")


def downgraded(alerts: DataFrame, key: str = "entity_id", group: str = "group_id", ts: str = "timestamp", hours: int = 4) -> DataFrame:
    """Lower ``level`` 3 to 4 where the entity had a level 3 in the same group within ``hours`` before."""
    before = F.lag(ts).over(Window.partitionBy(key, group, "level").orderBy(ts, "seq"))
    again = (F.col("level") == 3) & (F.timestamp_diff("MICROSECOND", before, F.col(ts)) < hours * 3_600_000_000)
    return alerts.withColumn("__again", F.coalesce(again, F.lit(False))).withColumn("level", F.when(F.col("__again"), 4).otherwise(F.col("level"))).drop("__again")


def escalate(alerts: DataFrame, rules: list[tuple[Column, str]], otherwise: str = "none", key: str = "entity_id", ts: str = "timestamp", hours: int = 4) -> DataFrame:
    """Add ``rule``, the first that matches, and ``suppressed``: the same rule for the entity within ``hours`` before."""
    first = F.lit(otherwise)
    for test, name in reversed(rules):
        first = F.when(test, name).otherwise(first)
    rows = alerts.withColumn("rule", first)
    before = F.lag(ts).over(Window.partitionBy(key, "rule").orderBy(ts, "seq"))
    return rows.withColumn("suppressed", F.coalesce(F.timestamp_diff("SECOND", before, F.col(ts)) < hours * 3600, F.lit(False)))


def quiet(ts: Column, zone: str, start: int, end: int) -> Column:
    """Whether a UTC instant is in the quiet hours of a zone; they may pass midnight."""
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def payloads(alerts: DataFrame, fields: list[str], ts: str = "timestamp", order: str = "seq", last: int = 100) -> DataFrame:
    """The last alerts as (seq, payload) in JSON."""
    return alerts.orderBy(F.desc(ts), F.desc(order)).limit(last).select(order, F.to_json(F.struct(*fields)).alias("payload"))


def distinct_records(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row per entity, time and metric, the first by seq."""
    per = Window.partitionBy(key, "timestamp", "metric_name").orderBy("seq")
    return records.withColumn("__n", F.row_number().over(per)).where(F.col("__n") == 1).drop("__n")
