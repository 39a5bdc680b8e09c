"""Rolling baselines over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import baseline as B
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S


def _points_sql(hour: str = "hour(ts)", weekend: str = "isodow(ts) >= 6") -> str:
    return f"SELECT event_id AS seq, ts, user_id::VARCHAR AS vm_id, event_type AS metric_name, value, ({hour})::BIGINT AS hour, {weekend} AS is_weekend FROM events"


def _score_sql(keys: str, points: str | None = None, robust: bool = False, extra: str = "") -> str:
    centre = "median(value) OVER f AS med, mad(value) OVER f AS dev," if robust else ""
    z = "CASE WHEN dev > 0 THEN 0.6745::DOUBLE * (value - med) / dev ELSE 0 END" if robust else "CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END"
    return f"""
    WITH p AS ({points or _points_sql()}),
    w AS (SELECT *, {centre} count(value) OVER f AS n, coalesce(avg(value) OVER f, 0) AS mu,
                 CASE WHEN min(value) OVER f = max(value) OVER f THEN 0 ELSE coalesce(stddev_pop(value) OVER f, 0) END AS sd
          FROM p WINDOW f AS (PARTITION BY {keys} ORDER BY ts, seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, n < 5 AS cold_start, CASE WHEN n < 5 THEN 0 ELSE {z} END::DOUBLE AS z_raw FROM w)
    SELECT seq, {extra} n, round(mu, 6) + 0.0::DOUBLE AS baseline_mean, round(sd::DOUBLE, 6) + 0.0::DOUBLE AS baseline_std, round(z_raw + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS z_score,
           cold_start, abs(z_raw) > 3 AS is_anomaly FROM z"""


# A billionth more keeps scores that end in 5 from being rounded either way.
def _out(scored, *extra):
    return scored.select("seq", *extra, "n", r6("baseline_mean").alias("baseline_mean"), r6("baseline_std").alias("baseline_std"), r6(F.col("z_score") + 1e-9).alias("z_score"), "cold_start", "is_anomaly")


def _points(spark, sf_dir):
    return S.metric_points(table(spark, sf_dir, "events"))


FLEET = ["metric_name", "hour", "is_weekend"]


@query(_score_sql("metric_name, hour, is_weekend"))
def z_rolling_fleet(spark, sf_dir):
    return _out(B.score(B.with_buckets(_points(spark, sf_dir)), FLEET))


@query(_score_sql("vm_id, metric_name"))
def z_rolling_entity_global(spark, sf_dir):
    return _out(B.score(_points(spark, sf_dir), ["vm_id", "metric_name"]))


@query(_score_sql("vm_id, metric_name, hour, is_weekend"))
def z_cold_start_fine(spark, sf_dir):
    return _out(B.score(B.with_buckets(_points(spark, sf_dir)), ["vm_id", *FLEET]))


@query(_score_sql("metric_name, hour", _points_sql("hour(ts) // 4", "NULL::BOOLEAN"), extra="hour,"))
def z_block4_nosplit(spark, sf_dir):
    return _out(B.score(B.with_buckets(_points(spark, sf_dir), hours=4, split_weekend=False), ["metric_name", "hour"]), big("hour").alias("hour"))


@query(_score_sql("metric_name, hour, is_weekend", robust=True))
def robust_rolling_fleet(spark, sf_dir):
    return _out(B.score(B.with_buckets(_points(spark, sf_dir)), FLEET, method="robust_zscore"))


_SEASON = "event_type NOT IN ('error', 'login')"
_KEY = """'phase0:baseline:' || vm_id || ':' || metric_name || ':' || CASE WHEN hour IS NULL THEN 'global'
          ELSE 'hour' || lpad(hour::VARCHAR, 2, '0') || CASE WHEN is_weekend THEN ':weekend' ELSE ':weekday' END END AS state_key,"""


@query(_score_sql("metric_name, hour, is_weekend", _points_sql(f"CASE WHEN {_SEASON} THEN hour(ts) END", f"CASE WHEN {_SEASON} THEN isodow(ts) >= 6 END"), extra=_KEY))
def seasonality_mixed(spark, sf_dir):
    points = B.with_buckets(_points(spark, sf_dir), seasonal_if=B.seasonal(deny=["error", "login"]))
    key = X.state_key(F.col("vm_id"), F.col("metric_name"), F.col("hour"), F.col("is_weekend"))
    return _out(B.score(points, FLEET), key.alias("state_key"))


@query(f"""
WITH p AS ({_points_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY metric_name, hour, is_weekend ORDER BY ts DESC, seq DESC) AS rn FROM p)
SELECT metric_name, hour, is_weekend, count(*) AS count, round(avg(value), 6) AS mean,
       round(CASE WHEN min(value) = max(value) THEN 0 ELSE stddev_pop(value) END::DOUBLE, 6) AS std, string_agg(round(value, 4)::VARCHAR, ',' ORDER BY ts, seq) AS readings
FROM r WHERE rn <= 30 GROUP BY ALL""")
def bucket_state_final(spark, sf_dir):
    state = B.final_state(B.with_buckets(_points(spark, sf_dir)), FLEET)
    readings = F.array_join(F.transform("window", lambda x: F.round(x, 4).cast("string")), ",")
    return state.select("metric_name", big("hour").alias("hour"), "is_weekend", "count", r6("mean").alias("mean"), r6("std").alias("std"), readings.alias("readings"))


@query(f"""
WITH p AS ({_points_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY metric_name, hour, is_weekend ORDER BY ts DESC, seq DESC) AS rn FROM p)
SELECT metric_name, hour, is_weekend, count(*) AS count, round(avg(value), 6) AS mean, count(*) AS held FROM r WHERE rn <= 30 GROUP BY ALL""")
def state_json_round_trip(spark, sf_dir):
    state = B.state_of(B.state_json(B.final_state(B.with_buckets(_points(spark, sf_dir)), FLEET)))
    return state.select("metric_name", big("hour").alias("hour"), "is_weekend", "count", r6("mean").alias("mean"), big(F.size("window")).alias("held"))


@query(f"WITH s AS ({_score_sql('metric_name, hour, is_weekend')}) SELECT count(*) AS processed, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (cold_start) AS cold FROM s")
def anomaly_counters(spark, sf_dir):
    return B.counters(B.score(B.with_buckets(_points(spark, sf_dir)), FLEET))


@query(f"WITH p AS ({_points_sql()}) SELECT hour, is_weekend, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM p GROUP BY ALL")
def diurnal_profile(spark, sf_dir):
    points = B.with_buckets(_points(spark, sf_dir))
    return points.groupBy(big("hour").alias("hour"), "is_weekend").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""
WITH p AS (SELECT event_id AS seq, user_id, event_type, ts, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, seq) AS rn FROM p)
SELECT a.seq, round(sum(b.value * pow(0.7::DOUBLE, a.rn - 1 - b.rn)) / sum(pow(0.7::DOUBLE, a.rn - 1 - b.rn)), 6) AS decayed_mean
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.rn BETWEEN a.rn - 30 AND a.rn - 1 GROUP BY a.seq""")
def decayed_baseline(spark, sf_dir):
    return B.decayed(_points(spark, sf_dir), ["vm_id", "metric_name"], alpha=0.3).select("seq", r6("decayed_mean").alias("decayed_mean"))


@query("""
SELECT user_id::VARCHAR AS vm_id, event_id AS seq, event_type AS metric_name, value FROM events WHERE user_id = 7 AND event_type = 'click'""")
def point_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").where((F.col("user_id") == 7) & (F.col("event_type") == "click"))
    return S.metric_points(events).select("vm_id", "seq", "metric_name", "value")
