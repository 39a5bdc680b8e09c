"""Wire events: the events table written as JSON lines, some of them broken on purpose by event number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ingest as I
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S


def wire_lines(spark, sf_dir):
    """(seq, at, payload): every 13th line lacks its cloud, others have a bad number, NaN, a bad time or no object."""
    rows = S.records(table(spark, sf_dir, "events"))
    n = F.col("seq")
    value = F.when(n % 17 == 0, "abc").when(n % 19 == 0, "NaN").otherwise(F.col("value").cast("string"))
    time = F.when(n % 23 == 0, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fields = {"entity_id": F.col("entity_id"), "timestamp": time, "cloud": F.when(n % 13 != 0, F.col("cloud")), "entity_type": F.col("entity_type"), "namespace": F.col("namespace"), "metric_name": F.col("metric_name"), "value": value}
    line = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return rows.select(n.alias("seq"), F.col("timestamp").alias("at"), F.when(n % 29 == 0, "[1]").otherwise(line).alias("payload"))


REASON = """CASE WHEN event_id % 29 = 0 THEN 'Not a JSON object' WHEN event_id % 13 = 0 THEN 'Missing required field(s): [''cloud'']'
 WHEN event_id % 23 = 0 THEN 'Unparseable timestamp: ''yesterday''' WHEN event_id % 17 = 0 THEN 'Non-numeric value: ''abc'''
 WHEN event_id % 19 = 0 THEN 'Non-finite value' END"""
CLOUD = "CASE user_id % 4 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure' WHEN 2 THEN 'GCP' ELSE 'OCI' END"
KIND = "CASE user_id % 3 WHEN 0 THEN 'Instances' WHEN 1 THEN 'Security_Groups' ELSE 'Virtual_Machines' END"


@query(f"""
WITH e AS (SELECT *, {REASON} AS reason FROM events)
SELECT event_id AS seq, reason, CASE WHEN reason IS NULL THEN user_id::VARCHAR END AS entity_id, CASE WHEN reason IS NULL THEN epoch(date_trunc('second', ts))::BIGINT END AS epoch,
       CASE WHEN reason IS NULL THEN {CLOUD} END AS cloud, CASE WHEN reason IS NULL THEN round(value, 6) END AS value FROM e""")
def validate_events(spark, sf_dir):
    rows = I.validate(wire_lines(spark, sf_dir))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select("seq", "reason", good(F.col("entity_id")).alias("entity_id"), good(F.unix_seconds(F.col("timestamp"))).alias("epoch"), good(F.col("cloud")).alias("cloud"), good(r6("value")).alias("value"))


@query(f"WITH e AS (SELECT {REASON} AS reason FROM events) SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason")
def dlq_reasons(spark, sf_dir):
    letters = I.dead_letters(I.validate(wire_lines(spark, sf_dir)), logged_at=F.lit("2024-01-01").cast("timestamp"))
    return letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS (SELECT (epoch(ts)::BIGINT // 300) * 300 AS start, {REASON} AS reason FROM (SELECT *, date_trunc('second', ts) AS t FROM events))
SELECT start, count(*) FILTER (reason IS NULL) AS n_valid, count(*) FILTER (reason IS NOT NULL) AS n_invalid,
       round((count(*) FILTER (reason IS NOT NULL))::DOUBLE / count(*), 6) AS error_rate FROM e GROUP BY start""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def error_rate_by_window(spark, sf_dir):
    out = I.batches(I.validate(wire_lines(spark, sf_dir)))
    return out.select(F.unix_seconds(F.col("batch_ts").cast("timestamp")).alias("start"), "n_valid", "n_invalid", r6("error_rate").alias("error_rate"))


@query("""
SELECT (floor(epoch(ts))::BIGINT // 300) * 300 AS start, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY start""")
def ingest_batches_5m(spark, sf_dir):
    rows = S.records(table(spark, sf_dir, "events")).select("timestamp", "seq")
    out = I.batch_records(rows)
    ids = F.array_join(F.transform("records", lambda r: r["seq"].cast("string")), ",")
    return out.select(F.unix_seconds(F.col("batch_ts").cast("timestamp")).alias("start"), big(F.size("records")).alias("n"), ids.alias("ids"))


@query("""
SELECT user_id::VARCHAR AS entity_id, event_type AS metric_name, epoch_us(ts) AS micros, min(event_id) AS seq FROM events GROUP BY ALL""")
def distinct_history(spark, sf_dir):
    from tidemark.operators.detect import distinct_records

    return distinct_records(S.records(table(spark, sf_dir, "events"))).select("entity_id", "metric_name", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), "seq")
