"""Parsing and validation of wire events, dead letters and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.sources.events import WIRE_SCHEMA

# A date, as ISO 8601 wants it; Spark alone would take a bare year or a time.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def timestamp(text: Column) -> Column:
    """UTC instant of an ISO 8601 string; without an offset it is UTC."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def local_timestamp(text: Column) -> Column:
    """The sender's own clock: the string without its offset."""
    bare = F.regexp_replace(text, r"(?<=:\d{2}|\.\d{1,9})(Z|[+-]\d{2}:?\d{2})$", "")
    return F.when(text.rlike(ISO), F.try_to_timestamp(bare))


def missing(fields: list[str], row: Column) -> Column:
    """Names of the fields that are null, in order."""
    return F.array_compact(F.array(*[F.when(row[f].isNull(), F.lit(f)) for f in fields]))


def validate(lines: DataFrame, payload: str = "payload", fields: list[str] = C.REQUIRED_FIELDS) -> DataFrame:
    """Parse JSON lines into typed fields and ``reason``, the first check that failed or null.

    Checks go: JSON object, missing fields, timestamp, number, finite. Other columns are kept.
    """
    row = F.from_json(F.col(payload), WIRE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumn("__r", row)
    r = F.col("__r")
    out = out.withColumns({"__ts": timestamp(r["timestamp"]), "__v": r["value"].try_cast("double"), "__missing": missing(fields, r)})
    v = F.col("__v")
    names = F.concat(F.lit("['"), F.array_join("__missing", "', '"), F.lit("']"))
    reason = (
        F.when(r["_corrupt"].isNotNull() | r.isNull(), "Not a JSON object")
        .when(F.size("__missing") > 0, F.concat(F.lit("Missing required field(s): "), names))
        .when(F.col("__ts").isNull(), F.concat(F.lit("Unparseable timestamp: '"), r["timestamp"], F.lit("'")))
        .when(v.isNull(), F.concat(F.lit("Non-numeric value: '"), r["value"], F.lit("'")))
        .when(F.isnan(v) | (F.abs(v) == float("inf")), "Non-finite value")
    )
    typed = {f: F.col("__ts") if f == "timestamp" else v if f == "value" else r[f] for f in fields}
    return out.withColumn("reason", reason).withColumns(typed).drop("__r", "__ts", "__v", "__missing")


def valid(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull()).drop("reason")


def dead_letters(validated: DataFrame, payload: str = "payload", logged_at: Column | None = None) -> DataFrame:
    """Rows for the dead-letter file."""
    at = F.current_timestamp() if logged_at is None else logged_at
    return validated.where(F.col("reason").isNotNull()).select(at.alias("logged_at"), "reason", F.col(payload).alias("raw_event"))


def reason_kind(reason: Column) -> Column:
    return F.regexp_extract(reason, r"^([^:(]+?)( field|:|$)", 1)


def batches(validated: DataFrame, at: str = "at", seconds: int = C.BATCH_SECONDS) -> DataFrame:
    """Tumbling event-time batches: valid and invalid counts and the share of bad events; empty windows have no row."""
    window = F.window(at, f"{seconds} seconds").alias("__w")  # grouped whole, as its start alone has no watermark
    out = validated.groupBy(window).agg(F.count_if(F.col("reason").isNull()).alias("n_valid"), F.count_if(F.col("reason").isNotNull()).alias("n_invalid"))
    rate = F.coalesce(F.try_divide("n_invalid", F.col("n_valid") + F.col("n_invalid")), F.lit(0.0))
    return out.select(F.col("__w.start").alias("batch_ts"), "n_valid", "n_invalid", rate.alias("error_rate"))


def observed(validated: DataFrame, observation) -> DataFrame:
    """Count received and invalid lines while they pass, into an ``Observation`` or a named metric of a stream."""
    return validated.observe(observation, F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNotNull()).alias("invalid"))


def batch_records(records: DataFrame, at: str = "timestamp", seconds: int = C.BATCH_SECONDS) -> DataFrame:
    """The records of each batch as an array, in order."""
    start = F.window(at, f"{seconds} seconds")["start"].alias("batch_ts")
    return records.groupBy(start).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in records.columns if c != at]))).alias("records"))
