"""Alerts from the events table: graded, de-duplicated, correlated, escalated; and the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.scratch import cut, shared_dir
from tidemark.operators import baseline as B
from tidemark.operators import detect as D
from tidemark.plans.baseline_queries import _score_sql
from tidemark.plans.ingest_queries import CLOUD, REASON, wire_lines
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S
from tidemark.streaming import scoring


def alerts(spark, sf_dir):
    """Every event as an alert whose score inputs follow from its value."""
    rows = S.records(table(spark, sf_dir, "events"))
    v = F.col("value")
    dev, drift = F.pmod(v, F.lit(1.0)), F.when(F.col("seq") % 7 != 0, F.pmod(v * 3, F.lit(1.0)))
    sim = F.when(F.col("seq") % 5 != 0, F.pmod(v * 7, F.lit(1.0)))
    score = F.round(D.final_score(dev, drift, sim), 6)
    return rows.withColumns({"score": score, "severity": D.severity(score)})


_ALERTS = f"""a AS (SELECT event_id AS seq, user_id::VARCHAR AS entity_id, ts, event_type, {CLOUD} AS cloud,
 round(0.4::DOUBLE * (value % 1.0::DOUBLE) + 0.4::DOUBLE * coalesce(CASE WHEN event_id % 7 <> 0 THEN (value * 3) % 1.0::DOUBLE END, 0.5) + 0.2::DOUBLE * (1 - coalesce(CASE WHEN event_id % 5 <> 0 THEN (value * 7) % 1.0::DOUBLE END, 0)), 6) AS score FROM events),
s AS (SELECT *, CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM a)"""


@query(f"WITH {_ALERTS} SELECT seq, score, severity FROM s")
def final_score_severity(spark, sf_dir):
    return alerts(spark, sf_dir).select("seq", "score", "severity")


@query(f"""WITH {_ALERTS}, b AS (SELECT *, floor(epoch(ts))::BIGINT // 300 AS bucket FROM s),
r AS (SELECT *, count(*) OVER p AS recurrence_count, row_number() OVER (PARTITION BY cloud, severity, bucket ORDER BY ts, seq) AS n FROM b WINDOW p AS (PARTITION BY cloud, severity, bucket))
SELECT seq, bucket, recurrence_count FROM r WHERE n = 1""")
def dedup_5m(spark, sf_dir):
    return D.deduplicate(alerts(spark, sf_dir), ["cloud", "severity"]).select("seq", "bucket", "recurrence_count")


_RULE = "CASE WHEN severity = 'CRITICAL' THEN 'page' WHEN severity = 'HIGH' AND cloud = 'AWS' THEN 'call' WHEN severity IN ('HIGH', 'MEDIUM') THEN 'mail' ELSE 'none' END"


@query(f"""WITH {_ALERTS}, r AS (SELECT *, {_RULE} AS rule FROM s), l AS (SELECT *, lag(ts) OVER (PARTITION BY entity_id, rule ORDER BY ts, seq) AS b FROM r)
SELECT seq, rule, coalesce(epoch_us(ts) - epoch_us(b) < 14400000000, false) AS suppressed FROM l""")
def escalation_first_match(spark, sf_dir):
    sev = F.col("severity")
    rules = [(sev == "CRITICAL", "page"), ((sev == "HIGH") & (F.col("cloud") == "AWS"), "call"), (sev.isin("HIGH", "MEDIUM"), "mail")]
    return D.escalate(alerts(spark, sf_dir), rules).select("seq", "rule", "suppressed")


_LEVEL = "greatest(1, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END - CASE WHEN entity_id::INT % 10 = 0 OR seq % 13 = 0 THEN 1 ELSE 0 END)"


@query(f"""WITH {_ALERTS}, r AS (SELECT *, {_LEVEL} AS l0, hour(ts - INTERVAL 5 HOUR) < 7 AS is_quiet FROM s),
b AS (SELECT *, lag(ts) OVER (PARTITION BY entity_id, cloud, l0 ORDER BY ts, seq) AS b FROM r),
l AS (SELECT *, CASE WHEN l0 = 3 AND epoch_us(ts) - epoch_us(b) < 14400000000 THEN 4 ELSE l0 END AS level FROM b)
SELECT seq, level, CASE WHEN level = 1 THEN 'page' WHEN is_quiet OR level = 4 THEN 'post' WHEN level = 2 THEN 'page' ELSE 'mail' END AS method FROM l""")
def severity_levels(spark, sf_dir):
    """Levels by the matrix, lowered where the same trouble was seen within four hours, and how each is sent."""
    rows = alerts(spark, sf_dir)
    criticality = F.when(F.col("entity_id").cast("int") % 10 == 0, "critical")
    group = F.when(F.col("seq") % 13 == 0, "REGIONAL_OUTAGE")
    rows = D.downgraded(rows.withColumn("level", D.sev_level(criticality, F.col("severity"), group)), group="cloud")
    is_quiet = D.quiet(F.col("timestamp").cast("timestamp"), "America/New_York", 0, 7)
    return rows.select("seq", "level", D.notify_method(F.col("level"), is_quiet).alias("method"))


@query(f"""WITH {_ALERTS}, m AS (SELECT entity_id, max(ts) AS last FROM s WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL)
SELECT seq FROM s JOIN m USING (entity_id) WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(last) <= 10800000000""")
def active_alerts(spark, sf_dir):
    """Alerts of the entities that were active in the three hours before an instant; the others are pruned."""
    return D.active(alerts(spark, sf_dir), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), idle_minutes=180).select("seq")


@query("SELECT event_id AS seq, hour(ts - INTERVAL 5 HOUR) >= 22 OR hour(ts - INTERVAL 5 HOUR) < 6 AS is_quiet FROM events")
def quiet_hours(spark, sf_dir):
    rows = S.records(table(spark, sf_dir, "events"))
    return rows.select("seq", D.quiet(F.col("timestamp").cast("timestamp"), "America/New_York", 22, 6).alias("is_quiet"))


@query(f"WITH {_ALERTS} SELECT seq, '{{\"entity_id\":\"' || entity_id || '\",\"cloud\":\"' || cloud || '\",\"severity\":\"' || severity || '\"}}' AS payload FROM s ORDER BY ts DESC, seq DESC LIMIT 100")
def recent_alerts(spark, sf_dir):
    return D.payloads(alerts(spark, sf_dir), ["entity_id", "cloud", "severity"])


_NEAR = f"""WITH RECURSIVE {_ALERTS}, c AS (SELECT entity_id, ts, cloud, event_type, 'r' || (entity_id::INT % 30)::VARCHAR AS region FROM s WHERE severity IN ('HIGH', 'CRITICAL')),
e AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM c x JOIN c y ON x.entity_id <> y.entity_id AND (x.cloud = y.cloud)::INT + (x.event_type = y.event_type)::INT + (x.region = y.region)::INT >= 2
  AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 600000000),
w AS (SELECT a AS node, a AS label FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.label = e.a)"""


@query(f"{_NEAR} SELECT node, min(label) AS label FROM w GROUP BY node")
def correlate_components(spark, sf_dir):
    rows = alerts(spark, sf_dir).where(F.col("severity").isin("HIGH", "CRITICAL"))
    rows = rows.withColumn("region", F.concat(F.lit("r"), (F.col("entity_id").cast("int") % 30).cast("string")))
    return D.correlate(rows, ["cloud", "metric_name", "region"])


@query(f"{_NEAR}, g AS (SELECT node, min(label) AS label FROM w GROUP BY node) SELECT label, 'r' || (node::INT % 5)::VARCHAR AS region, count(*) AS entities, count(*) > 10 AS is_regional FROM g GROUP BY ALL")
def correlate_regional(spark, sf_dir):
    regions = S.records(table(spark, sf_dir, "events")).select("entity_id", F.concat(F.lit("r"), (F.col("entity_id").cast("int") % 5).cast("string")).alias("region"))
    return D.regional(correlate_components(spark, sf_dir), regions)


@query(_score_sql("metric_name, hour, is_weekend"))
def stream_z_scores(spark, sf_dir):
    """The fleet's scores by a streaming query with keyed state, over the events in one micro-batch."""
    points = B.with_buckets(S.metric_points(table(spark, sf_dir, "events")))
    key = F.concat_ws("|", "metric_name", "hour", "is_weekend")
    rows = cut(points.select(key.alias("bucket"), F.col("timestamp").cast("timestamp").alias("timestamp"), "seq", "value"), "replay")
    stream = spark.readStream.schema(rows.schema).parquet(rows._scratch_path)
    scored = scoring.score_stream(stream)
    out = _to_table(scored, "append")
    return out.select("seq", big("n").alias("n"), r6("baseline_mean").alias("baseline_mean"), r6("baseline_std").alias("baseline_std"), r6(F.col("z_score") + 1e-9).alias("z_score"), "cold_start", "is_anomaly")


def _to_table(stream, mode):
    """Work a stream off into a Parquet table of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    query_ = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(f"""
WITH e AS (SELECT (floor(epoch(ts))::BIGINT // 300) * 300 AS start, {REASON} AS reason FROM events)
SELECT start, count(*) FILTER (reason IS NULL) AS n_valid, count(*) FILTER (reason IS NOT NULL) AS n_invalid FROM e GROUP BY start""")
def stream_batches(spark, sf_dir):
    """Event-time batches of 300 s by a streaming query, brought up to date by each micro-batch."""
    rows = cut(wire_lines(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")), "replay")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(rows._scratch_path)
    name = f"batches_{uuid.uuid4().hex}"
    out = scoring.run_to_end(scoring.batch_stream(stream, "at", "60 days"), f"{shared_dir(spark)}/tidemark/{name}", name, "complete")
    return out.select(F.unix_seconds("batch_ts").alias("start"), "n_valid", "n_invalid")


@query("SELECT event_id AS seq FROM events WHERE event_type = 'error'")
def stream_filter(spark, sf_dir):
    rows = cut(S.metric_points(table(spark, sf_dir, "events")), "replay")
    stream = spark.readStream.schema(rows.schema).parquet(rows._scratch_path)
    return _to_table(stream.where(F.col("metric_name") == "error").select("seq"), "append")
