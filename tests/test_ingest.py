"""Wire events: validation, dead letters, batches."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as I
from tidemark.streaming import scoring

GOOD = {"entity_id": "vm-1", "timestamp": "2025-11-11T00:00:00Z", "cloud": "AWS", "entity_type": "Instances", "namespace": "AWS/EC2", "metric_name": "cpu", "value": 42.0}


def check(spark, *events):
    lines = [e if isinstance(e, str) else json.dumps(e) for e in events]
    rows = I.validate(spark.createDataFrame(list(enumerate(lines)), "i int, payload string"))
    return sorted(rows.collect(), key=lambda r: r["i"])


def test_good_events(spark):
    times = ["2025-11-11T00:00:00Z", "2025-11-11T00:00:00+00:00", "2025-11-11T00:00:00", "2025-11-11T02:00:00+02:00"]
    rows = check(spark, *[GOOD | {"timestamp": t} for t in times], GOOD | {"value": "42.5", "entity_id": 12345})
    assert all(r["reason"] is None for r in rows)
    assert {r["timestamp"] for r in rows} == {dt.datetime(2025, 11, 11)}
    assert (rows[-1]["value"], rows[-1]["entity_id"]) == (42.5, "12345")


@pytest.mark.parametrize("field", list(GOOD))
def test_missing_fields(spark, field):
    row = check(spark, {k: v for k, v in GOOD.items() if k != field})[0]
    assert row["reason"] == f"Missing required field(s): ['{field}']"


def test_bad_events(spark):
    rows = check(spark, GOOD | {"cloud": None}, GOOD | {"value": "not-a-number"}, GOOD | {"value": "NaN"}, GOOD | {"value": "Infinity"}, GOOD | {"timestamp": "not-a-timestamp"}, GOOD | {"timestamp": "2025"}, "{bad", "[1]", '"x"')
    assert [r["reason"].split(":")[0].split(" field")[0] for r in rows] == [
        "Missing required", "Non-numeric value", "Non-finite value", "Non-finite value", "Unparseable timestamp", "Unparseable timestamp", *["Not a JSON object"] * 3,
    ]


def test_dead_letters_and_batches(spark):
    events = [GOOD] * 8 + [{k: v for k, v in GOOD.items() if k != "value"}]
    lines = spark.createDataFrame([(json.dumps(e), dt.datetime(2025, 11, 11, 0, i % 2)) for i, e in enumerate(events)], "payload string, at timestamp")
    rows = I.validate(lines)
    letters = I.dead_letters(rows).collect()
    assert [(r["reason"], json.loads(r["raw_event"])["entity_id"]) for r in letters] == [("Missing required field(s): ['value']", "vm-1")]
    batch = I.batches(rows).first()
    assert (batch["n_valid"], batch["n_invalid"], round(batch["error_rate"], 4)) == (8, 1, 0.1111)
    assert I.valid(rows).count() == 8
    assert I.batches(rows.where("false")).count() == 0


def test_local_time_drops_the_offset(spark):
    row = spark.range(1).select(F.hour(I.local_timestamp(F.lit("2025-11-11T23:30:00+02:00"))).alias("h"), F.hour(I.timestamp(F.lit("2025-11-11T23:30:00+02:00"))).alias("u")).first()
    assert (row["h"], row["u"]) == (23, 21)


def test_batch_stream_and_dead_letter_sink(spark, tmp_path):
    rows = [(json.dumps(GOOD), dt.datetime(2025, 11, 11, 0, 1)), ("[1]", dt.datetime(2025, 11, 11, 0, 2)), (json.dumps(GOOD), dt.datetime(2025, 11, 11, 9, 0))]
    lines = spark.createDataFrame(rows, "payload string, at timestamp")
    lines.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in")
    out = scoring.run_to_end(scoring.batch_stream(stream, "at"), f"{tmp_path}/state", "batches").collect()
    assert [(r["n_valid"], r["n_invalid"]) for r in out] == [(1, 1)]  # the later window is still open
    scoring.dead_letter_sink(f"{tmp_path}/dlq")(lines, 0)
    assert [r["reason"] for r in spark.read.json(f"{tmp_path}/dlq").collect()] == ["Not a JSON object"]
