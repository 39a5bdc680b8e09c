"""Sources: event tables, wire events, metric and alert documents, pairs, seeds.

A source is a function of a session and options that gives a DataFrame; batch and streaming sources are exchangeable.
Column pruning and predicates reach the scan because everything is declared on it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.functions import exprs as X

METRIC_SCHEMA = "vm_id string, metric_name string, timestamp timestamp, value double"
WIRE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*C.REQUIRED_FIELDS, "_corrupt"]])
SEED_DOC_SCHEMA = (
    "element_id string, resourceId string, category string, component string, metric string, namespace string, uri string, from_date timestamp, "
    "account_id string, unit string, metric_value array<map<string,double>>"
)
ALERT_SCHEMA = "alert_type string, event_creation_time timestamp, raw_data struct<resource_id:string,alert_state:string,metric_name:string,type:string,severity:string>"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan of the given columns only."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def orc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.orc(path)
    return df.select(*columns) if columns else df


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of wire lines from a folder; stands where no broker is."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "payload")


def kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Wire lines of a topic, from the earliest offset; needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("value").cast("string").alias("payload"))


def entries_payload(fields: F.Column) -> F.Column:
    """The JSON of a stream entry whose fields are nested under ``data`` or flat."""
    return F.coalesce(F.try_element_at(fields, F.lit("data")), F.to_json(fields))


def metric_points(events: DataFrame) -> DataFrame:
    """The events table as (vm_id, metric_name, timestamp, value, seq)."""
    return events.select(
        F.col("user_id").cast("string").alias("vm_id"), F.col("event_type").alias("metric_name"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"),
    )


def records(events: DataFrame) -> DataFrame:
    """The events table as canonical records, with attributes that follow from the user."""
    cloud = F.element_at(F.array(*[F.lit(c) for c in ("AWS", "Azure", "GCP", "OCI")]), (F.col("user_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(c) for c in ("Instances", "Security_Groups", "Virtual_Machines")]), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), cloud.alias("cloud"), kind.alias("entity_type"),
        F.concat(cloud, F.lit("/"), F.col("event_type")).alias("namespace"), F.col("event_type").alias("metric_name"), F.col("value").cast("double").alias("value"),
        F.col("event_id").alias("seq"),
    )


def metric_seeds(docs: DataFrame, start: str, end: str, max_entities: int | None = None, seed: int = 42) -> DataFrame:
    """Daily metric documents as seeds: in the period, three positive hours or more, entities capped by a seeded draw."""
    values = X.hourly_values(F.col("metric_value"))
    rows = docs.where(F.col("from_date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (F.size("metric_value") > 0))
    rows = rows.select(
        X.first_filled(F.col("element_id"), F.col("resourceId")).alias("entity_id"), F.coalesce("category", F.lit("Unknown")).alias("entity_type"),
        X.cloud(F.col("namespace"), F.coalesce(F.nullif(F.col("resourceId"), F.lit("")), F.col("element_id")), F.col("uri"), F.col("category"), F.col("component")).alias("cloud"),
        F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("metric", F.lit("unknown")).alias("metric_name"), F.date_trunc("DAY", "from_date").alias("date"),
        F.coalesce("account_id", F.lit("")).alias("account_id"), F.coalesce("unit", F.lit("")).alias("unit"), values.alias("hourly_values"),
    )
    rows = rows.where(F.size(F.filter("hourly_values", lambda x: x > 0)) >= 3)
    if max_entities:
        chosen = rows.select("entity_id").distinct().orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(max_entities)
        rows = rows.join(chosen, "entity_id", "left_semi")
    return rows


def alert_anchors(docs: DataFrame, start: str, end: str, limit: int = 50_000) -> DataFrame:
    """Monitoring alerts in the period as (entity_id, alert_ts, anomaly_type)."""
    rows = docs.where((F.col("alert_type") == "monitoring") & F.col("event_creation_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    rows = rows.where(F.nullif(F.col("raw_data.resource_id"), F.lit("")).isNotNull())
    return rows.select(
        F.col("raw_data.resource_id").alias("entity_id"), F.col("event_creation_time").alias("alert_ts"),
        X.anchor_type(F.coalesce("raw_data.type", F.lit("")), F.coalesce("raw_data.alert_state", F.lit(""))).alias("anomaly_type"),
    ).limit(limit)


def synthetic_seeds(spark: SparkSession, start: str, end: str, resources: int = 200, seed: int = 42) -> DataFrame:
    """Seeds of the fixed archetypes for each day; noise is drawn from hashes, so it repeats."""
    kinds = spark.createDataFrame(C.ARCHETYPES, "entity_type string, cloud string, namespace string, metric_name string, base double, pattern string")
    each = max(1, resources // len(C.ARCHETYPES))
    rows = kinds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    name = F.lower(F.regexp_replace("metric_name", " ", "_"))
    rows = rows.withColumn("entity_id", F.concat(F.lit("synthetic-"), F.lower("cloud"), F.lit("-"), name, F.lit("-"), F.lpad(F.col("i").cast("string"), 4, "0")))
    rows = rows.withColumn("mean", F.col("base") * (0.5 + 1.5 * X.unit_draw(F.lit(seed), F.col("entity_id"))))
    rows = rows.withColumn("date", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr("interval 1 day"))))
    weights = F.when(F.col("pattern") == "business_hours", F.array(*map(F.lit, C.BUSINESS_HOURS))).otherwise(F.array(*map(F.lit, C.ALWAYS_ON)))
    day = 0.85 + 0.3 * X.unit_draw(F.lit(seed + 1), F.col("entity_id"), F.col("date"))
    draw = lambda h, k: X.unit_draw(F.lit(seed + k), F.col("entity_id"), F.col("date"), h)
    noise = lambda h: F.sqrt(-2 * F.ln(1 - draw(h, 2))) * F.cos(F.lit(6.283185307179586) * draw(h, 3)) * F.col("mean") * 0.03
    values = F.transform(weights, lambda w, h: F.greatest(F.lit(0.0), F.col("mean") * w * day + noise(h)))
    unit = F.when(F.col("metric_name").contains("Bytes") | F.col("metric_name").contains("Network"), "Bytes").otherwise("Percent")
    account = F.concat(F.lit("synth-account-"), F.lpad((F.col("i") % 5).cast("string"), 2, "0"))
    return rows.select("entity_id", "entity_type", "cloud", "namespace", "metric_name", "date", account.alias("account_id"), unit.alias("unit"), values.alias("hourly_values"))


def synthetic_anchors(seeds: DataFrame, seed: int = 99) -> DataFrame:
    """An anchor on a tenth of an entity's days, from 8 to 20 o'clock; seven of ten are spikes."""
    days = seeds.select("entity_id", "date").distinct()
    draw = lambda k: X.unit_draw(F.lit(seed + k), F.col("entity_id"), F.col("date"))
    at = F.timestamp_add("MINUTE", (F.floor(8 + 12 * draw(1)) * 60 + F.floor(60 * draw(2))).cast("int"), F.col("date"))
    return days.where(draw(0) < 0.10).select("entity_id", at.alias("alert_ts"), F.when(draw(3) < 0.7, "spike").otherwise("recovery").alias("anomaly_type"))


def feature_meta(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, statistics) of a feature-metadata document; statistics may be objects or [mean, std] lists."""
    meta = json.loads(text)
    vocabulary = [(c, label, int(i)) for c, labels in meta["vocab_maps"].items() for label, i in labels.items()]
    pair = lambda s: (s["mean"], s["std"]) if isinstance(s, dict) else tuple(s)
    stats = [(m, *map(float, pair(s))) for m, s in meta["metric_value_stats"].items()]
    return spark.createDataFrame(vocabulary, "column string, label string, idx int"), spark.createDataFrame(stats, "metric_name string, mean double, std double")
