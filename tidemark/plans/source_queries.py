"""Sources and sinks: document scans, key rules, and what comes back of what was written."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.scratch import shared_dir
from tidemark.operators import features as E
from tidemark.operators import profiles as P
from tidemark.operators import sequences as Q
from tidemark.operators import vectors as V
from tidemark.plans.feature_queries import ORDERED, RECORDS, STATS, VOCAB, _records
from tidemark.plans.registry import big, query, r6, table
from tidemark.plans.vector_queries import ASKED, _knn, _knn_sql, vectors
from tidemark.sources import events as S
from tidemark.sources import sinks


@query("""
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) FILTER (value > 0) AS positive, count(*) AS hours FROM events GROUP BY ALL)
SELECT CASE WHEN user_id % 5 = 0 THEN 'r' || user_id::VARCHAR ELSE 'e' || user_id::VARCHAR END AS entity_id, epoch(day)::BIGINT AS day, hours, CASE WHEN user_id % 2 = 0 THEN 'Instances' ELSE 'Unknown' END AS entity_type
FROM d WHERE day BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND positive >= 3""")
def metric_seed_rows(spark, sf_dir):
    """Daily metric documents as seeds: in the period, with three positive hours, of entities that are drawn (here all)."""
    events, user = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    docs = events.groupBy("user_id", F.date_trunc("DAY", F.col("ts").cast("timestamp")).alias("from_date")).agg(F.collect_list(F.create_map(F.lit("Average"), F.col("value"))).alias("metric_value"))
    none = F.lit(None).cast("string")
    docs = docs.select(
        "from_date", "metric_value", F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("e"), user)).otherwise("").alias("element_id"), F.concat(F.lit("r"), user).alias("resourceId"),
        F.when(F.col("user_id") % 2 == 0, "Instances").alias("category"), none.alias("namespace"), none.alias("uri"), none.alias("component"), none.alias("metric"), none.alias("account_id"), none.alias("unit"),
    )
    rows = S.metric_seeds(docs, "2024-01-05", "2024-01-20", max_entities=10**6)
    return rows.select("entity_id", F.unix_seconds("date").alias("day"), big(F.size("hourly_values")).alias("hours"), "entity_type")


@query("""
SELECT 'e' || user_id::VARCHAR AS entity_id, count(*) AS alerts, count(*) FILTER (event_type <> 'view') AS spikes FROM events
WHERE event_id % 3 > 0 AND user_id % 7 > 0 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' GROUP BY entity_id""")
def alert_anchor_counts(spark, sf_dir):
    """Monitoring alerts of the period by resource; those without a resource are no anchors."""
    n, user = F.col("event_id"), F.col("user_id")
    raw = F.struct(
        F.when(user % 7 != 0, F.concat(F.lit("e"), user.cast("string"))).otherwise("").alias("resource_id"), F.when(F.col("event_type") == "view", "FIRING_TO_OK").alias("type"), F.lit(None).cast("string").alias("alert_state"),
    )
    docs = table(spark, sf_dir, "events").select(F.when(n % 3 > 0, "monitoring").otherwise("audit").alias("alert_type"), F.col("ts").cast("timestamp").alias("event_creation_time"), raw.alias("raw_data"))
    rows = S.alert_anchors(docs, "2024-01-03", "2024-01-25", limit=10**9)
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("anomaly_type") == "spike").alias("spikes"))


@query("""
SELECT event_id AS seq, substr(md5(user_id::VARCHAR), 1, 8) AS short, substr(sha256('[' || user_id::VARCHAR || ',' || event_id::VARCHAR || ']'), 1, 8) AS cache_key FROM events""")
def derived_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), X.short_hash(F.col("user_id").cast("string")).alias("short"), X.vector_key(F.array("user_id", "event_id")).alias("cache_key"))


@query("""SELECT n, greatest(4, least(n // 2, 32)) AS embed_dim, greatest(1, least(100, greatest(1, n * 50 // 39), n * 50)) AS cells FROM range(1, 200) r(n)""")
def width_rules(spark, sf_dir):
    """Widths of embeddings by vocabulary, and cells of an index by vectors."""
    return spark.createDataFrame([(n, X.embed_dim(n), X.cells_for(50 * n)) for n in range(1, 200)], "n long, embed_dim long, cells long")


@query("SELECT event_id AS seq FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-13 06:30:00' AND TIMESTAMP '2024-01-20 06:30:00'")
def look_back_rows(spark, sf_dir):
    rows = S.records(table(spark, sf_dir, "events"))
    return P.look_back(rows, F.lit("2024-01-20 06:30:00").cast("timestamp_ntz"), days=7).select("seq")


@query(f"WITH r AS ({RECORDS}), s AS ({STATS}), v AS ({VOCAB}) SELECT \"column\" || ':' || label AS name, idx::DOUBLE AS a, NULL::DOUBLE AS b FROM v UNION ALL SELECT metric_name, round(mean, 6), round(std, 6) FROM s")
def feature_meta_round_trip(spark, sf_dir):
    """Vocabularies and statistics, written as one JSON document and read again."""
    records = _records(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # a document of the driver's own
        path = Path(folder) / "meta.json"
        sinks.feature_meta(str(path), E.vocabulary(records), E.metric_stats(records))
        vocabulary, stats = S.feature_meta(spark, path.read_text())
    names = vocabulary.select(F.concat("column", F.lit(":"), "label").alias("name"), F.col("idx").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    return names.unionByName(stats.select(F.col("metric_name").alias("name"), r6("mean").alias("a"), r6("std").alias("b")))


@query(f"WITH r AS ({RECORDS}), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id {ORDERED}) - 1 AS rn FROM r) SELECT entity_id, seq, rn // 32 AS window_id, rn % 32 AS pos FROM n")
def windows_shuffled(spark, sf_dir):
    rows = Q.shuffled(Q.tumbling(_records(spark, sf_dir)), ["entity_id", "window_id"], seed=3)
    return rows.select("entity_id", "seq", big("window_id").alias("window_id"), big("pos").alias("pos"))


@query("SELECT event_id AS seq, event_type AS metric_name, round(value, 6) + 0.0::DOUBLE AS value FROM events")
def parquet_round_trip(spark, sf_dir):
    """Records written by metric and read again."""
    path = f"{shared_dir(spark)}/tidemark/sink-{uuid.uuid4().hex}"
    sinks.parquet(_records(spark, sf_dir).select("seq", "metric_name", "value"), path, partition_by=["metric_name"])
    return spark.read.parquet(path).select("seq", "metric_name", r6("value").alias("value"))


@query(_knn_sql())
def index_round_trip(spark, sf_dir):
    """An index written in two parts, loaded and searched in all of its cells."""
    rows = vectors(spark, sf_dir)
    centres = V.train_cells(rows)
    path = f"{shared_dir(spark)}/tidemark/index-{uuid.uuid4().hex}"
    V.build_index(rows.where("vec_id % 2 = 0"), path, centres)
    V.build_index(rows.where("vec_id % 2 = 1"), path, centres, mode="append")
    indexed, loaded = V.load_index(spark, path)
    return _knn(V.nearest_in_cells(rows.where(ASKED), indexed, loaded, probe=len(loaded)))


@query(_knn_sql(exclude=True))
def search_cached(spark, sf_dir):
    """The second of two equal requests, which is read from the first one's table."""
    rows, cache = vectors(spark, sf_dir), V.SearchCache()
    cache.search(sf_dir, rows.where(ASKED), rows, exclude_own=True)
    return _knn(cache.search(sf_dir, rows.where(ASKED), rows, exclude_own=True))
