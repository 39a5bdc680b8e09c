"""Corpus synthesis. Metric and alert documents follow from the events table; identifiers from its users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.operators import corpus as K
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S


def _resources(events):
    """Identifiers of all shapes, by user."""
    u = F.col("user_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (u % len(xs) + 1).cast("int"))
    return events.select("user_id").distinct().select(
        "user_id", F.concat(pick("i-", "ocid1.instance.", "/subscriptions/x/", "projects/p/", "disk-", "sg-", ""), u.cast("string")).alias("rid"),
        pick("", "AWS/EC2", "oci_db", "Microsoft.Compute", "custom").alias("ns"), pick("", "", "Virtual_Machines", "Instances", "", "EC2 fleet", "").alias("cat"), pick("", "GCP-eu", "").alias("uri"),
    )


_RES = """SELECT DISTINCT user_id, (['i-', 'ocid1.instance.', '/subscriptions/x/', 'projects/p/', 'disk-', 'sg-', ''])[user_id % 7 + 1] || user_id::VARCHAR AS rid,
 (['', 'AWS/EC2', 'oci_db', 'Microsoft.Compute', 'custom'])[user_id % 5 + 1] AS ns, (['', '', 'Virtual_Machines', 'Instances', '', 'EC2 fleet', ''])[user_id % 7 + 1] AS cat,
 (['', 'GCP-eu', ''])[user_id % 3 + 1] AS uri FROM events"""


@query(f"""
WITH r AS ({_RES}) SELECT user_id, CASE
 WHEN rid LIKE 'i-%' OR rid LIKE 'sg-%' OR rid LIKE 'vol-%' OR rid LIKE 'arn:aws%' OR contains(ns, 'AWS') OR contains(uri, 'AWS') OR contains(cat, 'EC2') OR contains(cat, 'AWS') THEN 'AWS'
 WHEN rid LIKE 'ocid%' OR lower(ns) LIKE 'oci%' OR contains(uri, 'OCI') OR contains(cat, 'OCI') THEN 'OCI'
 WHEN contains(rid, '/subscriptions/') OR ns LIKE 'Microsoft%' OR contains(uri, 'Azure') OR contains(cat, 'Azure') OR contains(cat, 'Virtual_Machines') THEN 'Azure'
 WHEN contains(rid, 'compute.googleapis') OR contains(uri, 'GCP') OR contains(cat, 'GCP') OR contains(rid, 'projects/') THEN 'GCP' ELSE 'Unknown' END AS cloud FROM r""")
def cloud_detect(spark, sf_dir):
    rows = _resources(table(spark, sf_dir, "events"))
    return rows.select("user_id", X.cloud(F.col("ns"), F.col("rid"), F.col("uri"), F.col("cat"), F.lit(None).cast("string")).alias("cloud"))


def _daily(events):
    """(user_id, hours): 24 hourly means of a user's values by hour, null where there is none."""
    rows = events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.round(F.avg("value"), 4).alias("v"))
    by_hour = F.map_from_entries(F.collect_list(F.struct("h", "v")))
    return rows.groupBy("user_id").agg(by_hour.alias("m")).select("user_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at("m", h)).alias("hourly_values"))


_DAILY = """d AS (SELECT user_id, hour(ts) AS h, round(avg(value), 4) AS v FROM events GROUP BY ALL),
g AS (SELECT u.user_id, h.h, d.v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(24) h(h) LEFT JOIN d ON d.user_id = u.user_id AND d.h = h.h)"""
_FILL = f"""WITH {_DAILY},
f AS (SELECT user_id, h, v, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER b AS ph,
  first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER a AS nh
  FROM g WINDOW b AS (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT user_id, h, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL OR ph = nh THEN pv ELSE pv + (nv - pv) * ((h - ph) / (nh - ph)::DOUBLE) END AS v FROM f)"""


@query(f"{_FILL} SELECT user_id, h AS hour, round(v + 1e-9::DOUBLE, 6) AS value FROM filled")
def hourly_linear_fill(spark, sf_dir):
    rows = K.filled_hours(_daily(table(spark, sf_dir, "events")))
    return rows.select("user_id", F.posexplode("hours").alias("hour", "v")).select("user_id", big("hour").alias("hour"), r6(F.col("v") + 1e-9).alias("value"))


@query(f"{_FILL} SELECT user_id, (h * 60 + m.m)::BIGINT AS minute, h AS hour_of_day, m.m AS minute_of_hour, round(v + 1e-9::DOUBLE, 6) AS hour_anchor FROM filled CROSS JOIN range(60) m(m)")
def minute_expand(spark, sf_dir):
    seeds = _daily(table(spark, sf_dir, "events"))
    seeds = seeds.select("user_id", F.col("user_id").cast("string").alias("entity_id"), F.lit("m").alias("metric_name"), F.lit("2024-01-01").cast("timestamp").alias("date"), "hourly_values")
    rows = K.minutes(seeds, noise=0.0)
    minute = F.col("hour_of_day") * 60 + F.col("minute_of_hour")
    return rows.select("user_id", big(minute).alias("minute"), big("hour_of_day").alias("hour_of_day"), big("minute_of_hour").alias("minute_of_hour"), r6(F.col("hour_anchor") + 1e-9).alias("hour_anchor"))


@query()
def minute_spline(spark, sf_dir):
    seeds = _daily(table(spark, sf_dir, "events"))
    seeds = seeds.select("user_id", F.col("user_id").cast("string").alias("entity_id"), F.lit("m").alias("metric_name"), F.lit("2024-01-01").cast("timestamp").alias("date"), "hourly_values")
    return K.minutes(seeds).select("user_id", "timestamp", "value", "hour_anchor")


@query("""
WITH e AS (SELECT event_id, value AS a, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS avg_, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS low FROM events)
SELECT event_id, CASE WHEN avg_ <> 0 THEN avg_ WHEN event_id % 2 = 0 AND low IS NOT NULL AND low <> 0 THEN low WHEN event_id % 2 = 1 THEN a * 3 END AS value FROM e""")
def hourly_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    n, v = F.col("event_id"), F.col("value")
    average = F.when(n % 3 == 0, 0.0).otherwise(v)
    low = F.when(n % 5 != 0, v * 2)
    even = F.create_map(F.lit("Average"), average, F.lit("average"), low)
    odd = F.create_map(F.lit("Average"), average, F.lit("Sum"), v * 3)
    entries = F.array(F.when(n % 2 == 0, even).otherwise(odd))
    return rows.select("event_id", F.get(X.hourly_values(entries), F.lit(0)).alias("value"))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' OR event_id % 4 = 0 THEN 'spike' WHEN event_type = 'error' OR event_id % 4 = 1 THEN 'recovery' ELSE 'spike' END AS anomaly_type,
  CASE WHEN event_id % 3 = 0 THEN 'e' || user_id::VARCHAR WHEN event_id % 3 = 1 THEN 'r' || user_id::VARCHAR ELSE 'unknown' END AS entity, substr(md5(user_id::VARCHAR), 1, 8) AS short
FROM events""")
def document_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    transition = F.when(F.col("event_type") == "click", "OK_TO_FIRING").when(F.col("event_type") == "error", "FIRING_TO_OK").otherwise("")
    state = F.when(n % 4 == 0, "FIRING").when(n % 4 == 1, "OK").otherwise("")
    first = X.first_filled(F.when(n % 3 == 0, F.concat(F.lit("e"), u)).otherwise(""), F.when(n % 3 == 1, F.concat(F.lit("r"), u)))
    return rows.select("event_id", X.anchor_type(transition, state).alias("anomaly_type"), first.alias("entity"), X.short_hash(u).alias("short"))


def _effects(events):
    """Every error event is an anchor whose effect follows from its number."""
    n = F.col("event_id")
    rows = events.where(F.col("event_type") == "error")
    return rows.select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp").alias("alert_ts"), n.alias("anchor_id"), F.when(n % 10 < 7, "spike").otherwise("recovery").alias("anomaly_type"),
        (n % 300 + 60).cast("int").alias("half"), F.when(n % 10 < 7, 3.0 + (n % 4)).otherwise(0.05 * (1 + n % 3)).alias("factor"),
    )


@query("""
WITH a AS (SELECT user_id, ts AS alert_ts, event_id AS anchor_id, CASE WHEN event_id % 10 < 7 THEN 'spike' ELSE 'recovery' END AS t, event_id % 300 + 60 AS half,
   CASE WHEN event_id % 10 < 7 THEN 3.0::DOUBLE + event_id % 4 ELSE 0.05::DOUBLE * (1 + event_id % 3) END AS factor FROM events WHERE event_type = 'error'),
m AS (SELECT e.event_id, e.value, a.factor, a.t, a.alert_ts, a.anchor_id FROM events e LEFT JOIN a ON a.user_id = e.user_id AND date_trunc('day', a.alert_ts) = date_trunc('day', e.ts)
   AND abs(trunc(epoch_us(e.ts) / 1000000.0 - epoch_us(a.alert_ts) / 1000000.0)) <= a.half * 60)
SELECT event_id AS seq, round(any_value(value) * coalesce(exp(sum(ln(factor))), 1), 5) AS value, count(factor) > 0 AS is_anomaly, coalesce(arg_max(t, (alert_ts, anchor_id)) FILTER (t IS NOT NULL), '') AS anomaly_type
FROM m GROUP BY event_id""")
def inject_anomalies(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp").alias("timestamp"), "value", F.col("event_id").alias("seq"))
    out = K.inject(rows, _effects(events), order=["alert_ts", "anchor_id"])
    return out.select("seq", F.round("value", 5).alias("value"), "is_anomaly", "anomaly_type")


@query("""
WITH c AS (SELECT user_id::VARCHAR AS entity_id, event_type AS metric_name, ts, event_type = 'error' AS is_anomaly, CASE WHEN user_id % 7 = 0 THEN 'Unknown' ELSE 'AWS' END AS cloud FROM events)
SELECT count(*) AS total_rows, count(DISTINCT entity_id) AS unique_entities, count(DISTINCT metric_name) AS unique_metrics, count(*) FILTER (is_anomaly) AS anomaly_rows,
 round(avg(is_anomaly::INT), 6) AS anomaly_fraction, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last, round(avg((cloud = 'Unknown')::INT), 6) AS unknown_cloud FROM c""")
def corpus_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("metric_name"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") == "error").alias("is_anomaly"), F.when(F.col("user_id") % 7 == 0, "Unknown").otherwise("AWS").alias("cloud"))
    out = K.summary(rows)
    floats = {c: r6(c) for c in ("anomaly_fraction", "unknown_cloud")}
    return out.withColumns(floats | {c: F.unix_seconds(F.col(c)) for c in ("first", "last")})


@query("""
WITH c AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'Unknown' WHEN user_id % 2 = 0 THEN 'AWS' ELSE 'OCI' END AS cloud FROM events) SELECT cloud, count(*) AS n FROM c GROUP BY cloud""")
def cloud_distribution(spark, sf_dir):
    cloud = F.when(F.col("user_id") % 7 == 0, "Unknown").when(F.col("user_id") % 2 == 0, "AWS").otherwise("OCI")
    return table(spark, sf_dir, "events").groupBy(cloud.alias("cloud")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT user_id::VARCHAR AS entity_id, event_type AS metric_name, date_trunc('hour', ts) AS h FROM events GROUP BY ALL),
g AS (SELECT *, lag(h) OVER (PARTITION BY entity_id, metric_name ORDER BY h) AS b FROM t)
SELECT entity_id, metric_name, sum(coalesce(epoch(h) - epoch(b), 3600)::BIGINT // 3600 - 1)::BIGINT AS gaps FROM g GROUP BY ALL""")
def hour_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("metric_name"), F.col("ts").cast("timestamp").alias("timestamp"))
    return K.hour_gaps(rows).select("entity_id", "metric_name", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


@query()
def synthetic_corpus(spark, sf_dir):
    seeds = S.synthetic_seeds(spark, "2024-01-01", "2024-01-02", resources=18)
    return K.build(seeds, S.synthetic_anchors(seeds))


_KINDS = ", ".join(f"('{cloud}', '{metric}')" for _, cloud, _, metric, _, _ in C.ARCHETYPES)


@query(f"""
WITH k(cloud, metric_name) AS (VALUES {_KINDS})
SELECT 'synthetic-' || lower(cloud) || '-' || replace(lower(metric_name), ' ', '_') || '-' || lpad(i::VARCHAR, 4, '0') AS entity_id, cloud, metric_name, epoch(TIMESTAMP '2024-01-01')::BIGINT + 86400 * d AS day,
  'synth-account-' || lpad((i % 5)::VARCHAR, 2, '0') AS account_id, CASE WHEN contains(metric_name, 'Bytes') OR contains(metric_name, 'Network') THEN 'Bytes' ELSE 'Percent' END AS unit, 24::BIGINT AS hours
FROM k, range(10) i(i), range(7) d(d)""")
def synthetic_seed_rows(spark, sf_dir):
    seeds = S.synthetic_seeds(spark, "2024-01-01", "2024-01-07", resources=90)
    return seeds.select("entity_id", "cloud", "metric_name", F.unix_seconds("date").alias("day"), "account_id", "unit", big(F.size("hourly_values")).alias("hours"))
