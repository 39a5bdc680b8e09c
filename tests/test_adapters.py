"""Polled clients, state as JSON, counters and model files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import baseline as B
from tidemark.operators import encoder as N
from tidemark.operators import ingest as I
from tidemark.operators import sequences as Q
from tidemark.sources import adapters, events


def test_polled_stream_reads_every_line_once(spark, tmp_path):
    lines = [f"line {i}" for i in range(7)]
    (tmp_path / "lines.json").write_text(json.dumps(lines))
    spark.dataSource.register(adapters.PolledSource)
    options = {"client": "tidemark.sources.adapters:ListClient", "path": f"{tmp_path}/lines.json", "limit": "3"}
    out = lambda: spark.readStream.format("polled").options(**options).load()
    query = out().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["payload"] for r in spark.read.schema("payload string").parquet(f"{tmp_path}/out").collect()) == lines


def test_missing_client_libraries_fail_on_use_only():
    with pytest.raises(ModuleNotFoundError):
        adapters.client_of({"client": "tidemark.sources.adapters:RedisStreamClient", "stream": "s", "url": "redis://x"})


def test_entry_payloads(spark):
    rows = spark.createDataFrame([({"data": '{"a":1}'},), ({"a": "1"},)], "f map<string,string>")
    assert [r[0] for r in rows.select(events.entries_payload(F.col("f"))).collect()] == ['{"a":1}', '{"a":"1"}']


def test_state_round_trip(spark):
    state = spark.createDataFrame([("b", 2, 1.5, 0.5, [1.0, 2.0])], "bucket string, count long, mean double, std double, window array<double>")
    assert B.state_of(B.state_json(state)).first() == state.first()
    assert tuple(B.state_of(spark.createDataFrame([("b", None)], "bucket string, state string")).first()) == ("b", 0, 0.0, 0.0, [])


def test_observed_counts(spark):
    seen = Observation()
    rows = I.observed(I.validate(spark.createDataFrame([("[1]",), ("{}",)], "payload string")), seen)
    rows.collect()
    assert seen.get == {"received": 2, "invalid": 2}


def test_weights_by_registry_entry(tmp_path):
    meta = {"vocab_maps": {c: {"x": 1, "y": 2} for c in C.CATEGORICAL}}
    weights = N.seeded_weights([3] * 4)
    (tmp_path / "w.npz").write_bytes(N.save_weights(weights))
    loaded = N.from_entry({"weights_path": f"{tmp_path}/w.npz"}, meta)
    assert all(np.array_equal(loaded[k], v) for k, v in weights.items())
    assert len(N.time2vec_parameters(loaded)["weights"]) == C.TIME2VEC


def test_shuffled_windows_stay_together(spark):
    rows = spark.createDataFrame([(w, p) for w in range(20) for p in range(3)], "window_id int, pos int")
    out = [r["window_id"] for r in Q.shuffled(rows, ["window_id"], seed=1).collect()]
    assert all(out[i] == out[i + 1] == out[i + 2] for i in range(0, 60, 3)) and out != sorted(out)

