"""Profiles and their store, guards, health, processing-time batches, drift nulls, correlation, searches kept."""

from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards as G
from tidemark.operators import detect as D
from tidemark.operators import encoder as N
from tidemark.operators import profiles as P
from tidemark.operators import vectors as V
from tidemark.sources import adapters, sinks
from tidemark.streaming import health

T0 = dt.datetime(2025, 11, 11, 6)


def unit(*x: float) -> list[float]:
    v = np.array(x) / np.linalg.norm(x)
    return [float(i) for i in v]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, seq long, embedding array<float>")


def test_profile_upkeep(spark, tmp_path):
    store = P.EntityStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0 and store.versions() == []
    history = vectors(spark, [("a", i, unit(1, 0.1 * i)) for i in range(4)] + [("b", 1, unit(0, 1))])
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    P.refresh(store, history, known)
    rows = {r["entity_id"]: r for r in store.read().collect()}
    assert rows["c"]["cold_start"] and rows["c"]["n_records"] == 0 and not rows["a"]["cold_start"] and rows["a"]["n_records"] == 4
    before = rows["a"]
    far = unit(-1, 0)
    everything = history.unionByName(vectors(spark, [("a", 9, far), ("c", 9, unit(1, 1)), ("d", 9, unit(1, 2))]))
    new = everything.where("seq = 9")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    alarms = {r["entity_id"]: r["drift_alarm"] for r in P.update(store, new, asked, everything).collect()}
    assert alarms == {"a": True, "b": False, "c": False, "d": False}
    rows = {r["entity_id"]: r for r in store.read().collect()}
    moved = 0.1 * np.array(far) + 0.9 * np.array(before["centroid"])
    assert rows["a"]["centroid"] == pytest.approx(list(moved / np.linalg.norm(moved)), abs=1e-6)
    held = np.array([*before["history"], far])
    assert rows["a"]["n_records"] == 5 and rows["a"]["variance"] == pytest.approx(held.var(axis=0, ddof=1).sum(), abs=1e-6)
    assert rows["a"]["history"][-1] == pytest.approx(far) and not rows["c"]["cold_start"] and rows["d"]["n_records"] == 1
    assert rows["b"]["n_records"] == 1 and len(store.versions()) == 2
    store.write(store.fetch(known.where("entity_id = 'a'")))
    assert len(store.versions()) == 2 and store.read().count() == 4


def test_long_histories_keep_the_last_thirty(spark):
    old = vectors(spark, [("a", i, unit(1, i)) for i in range(40)])
    prior = P.full_build(old, old.select("entity_id"))
    new = vectors(spark, [("a", i, unit(2, i)) for i in range(3)])  # their order starts anew
    (row,) = P.incremental(prior, new, new.select("entity_id"), old).collect()
    assert len(row["history"]) == 30 and row["history"][-1] == pytest.approx(unit(2, 2)) and row["history"][0] == pytest.approx(unit(1, 13))


def test_guards(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "a int, v array<double>")
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        G.require_columns(df, ["y", "a", "x"])
    assert G.missing_columns(df, ["a"]) == [] and G.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="k must be positive"):
        V.nearest(df, df, k=0)
    assert df.select(G.of_width(F.col("v"), 2)).count() == 1
    with pytest.raises(Exception, match="width 3"):
        df.select(G.of_width(F.col("v"), 3).alias("v")).collect()
    with pytest.raises(TypeError):
        G.frame(spark, [1, 2])
    assert G.frame(spark, pd.DataFrame({"a": [1]}), ["a"]).count() == 1
    drawn = [r[0] for r in G.sample(spark.range(1000), 10, "id").collect()]
    assert drawn == [r[0] for r in G.sample(spark.range(1000).repartition(7), 10, "id").collect()] and len(set(drawn)) == 10


def test_index_guards(spark, tmp_path):
    rows = spark.createDataFrame([(i, "e", [float(i), 1.0]) for i in range(4)], "vec_id long, entity_id string, embedding array<float>")
    with pytest.raises(ValueError, match="not trained"):
        V.build_index(rows, str(tmp_path / "i"), [])
    with pytest.raises(ValueError, match="entity_id"):
        V.build_index(rows.drop("entity_id"), str(tmp_path / "i"), [np.zeros(2)])
    with pytest.raises(Exception, match="width 3"):
        V.build_index(rows, str(tmp_path / "i"), [np.zeros(3)])


def test_searches_are_kept_until_they_expire(spark):
    rows = spark.createDataFrame([(i, "e", [float(i), 1.0]) for i in range(4)], "vec_id long, entity_id string, embedding array<float>")
    now = [0.0]
    cache = V.SearchCache(clock=lambda: now[0])
    first = cache.search("v1", rows, rows, k=2)
    now[0] = 1799.0
    assert cache.search("v1", rows, rows, k=2) is first and cache.search("v1", rows, rows, k=3) is not first
    now[0] = 1800.0
    again = cache.search("v1", rows, rows, k=2)
    assert again is not first and again.count() == 8


def test_drift_null_and_score(spark):
    draw = np.random.default_rng(2)
    past = [("e", i, [float(x) for x in draw.standard_normal(6)]) for i in range(40)] + [("one", 1, [0.0] * 6)]
    rows = spark.createDataFrame(past, "entity_id string, id long, embedding array<double>")
    null = D.mmd_null(rows, pairs=60).toPandas()
    assert set(null["entity_id"]) == {"e"} and len(null) == 60
    x = np.array([r[2] for r in past[:-1]])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    sigma = np.median(np.sqrt(d[np.triu_indices(40, 1)])) / np.sqrt(2)
    kernel = np.exp(-d / (2 * sigma**2))
    order = np.argsort(np.random.default_rng(42).random((60, 40)), axis=1)
    for i in range(60):
        a, b = order[i][:20], order[i][20:]
        within = lambda s: np.mean([kernel[p, q] for p in s for q in s if p != q])
        assert null["mmd2"][i] == pytest.approx(within(a) + within(b) - 2 * kernel[np.ix_(a, b)].mean(), abs=1e-9)
    mmds = spark.createDataFrame([("e", 10.0), ("one", 0.1)], "entity_id string, mmd2 double")
    scored = {r["entity_id"]: (r["drift"], r["drift_flag"]) for r in D.drift_score(mmds, spark.createDataFrame(null)).collect()}
    assert scored == {"e": (1.0, True), "one": (0.5, False)}


def test_correlation_equals_all_pairs(spark):
    draw = random.Random(3)
    rows = [(f"e{draw.randrange(60)}", T0 + dt.timedelta(microseconds=draw.randrange(6 * 3600 * 10**6)), draw.choice("xy"), draw.choice("pq"), draw.choice("st"), i) for i in range(150)]
    rows += [("u", T0, "z", "z", "z", 200), ("v", T0 + dt.timedelta(minutes=10), "z", "z", "z", 201), ("w", T0 + dt.timedelta(minutes=20, microseconds=1), "z", "z", "z", 202)]
    label = {r[0]: r[0] for r in rows}
    for _ in range(60):
        for a in rows:
            for b in rows:
                if abs(a[1] - b[1]) <= dt.timedelta(minutes=10) and sum(a[i] == b[i] for i in (2, 3, 4)) >= 2:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
    linked = {a[0] for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) <= dt.timedelta(minutes=10) and sum(a[i] == b[i] for i in (2, 3, 4)) >= 2}
    alerts = spark.createDataFrame(rows, "entity_id string, timestamp timestamp_ntz, a string, b string, c string, seq long")
    assert {r["node"]: r["label"] for r in D.correlate(alerts, ["a", "b", "c"]).collect()} == {n: label[n] for n in linked}
    assert label["u"] == label["v"] == "u" and "w" not in linked
    as_of = F.lit(T0 + dt.timedelta(minutes=40)).cast("timestamp_ntz")
    seen = {r["entity_id"] for r in D.active(alerts.where("a = 'z'"), as_of).collect()}
    assert seen == {"v", "w"}


def test_online_encoding(spark):
    weights = N.seeded_weights([5, 5, 5, 5])
    step = {"num": [0.1, 0.2, 0.3], "cat": [1, 2, 3, 4], "ts": 0.5}
    schema = "entity_id string, steps array<struct<num:array<float>,cat:array<int>,ts:float>>, length int"
    rows = spark.createDataFrame([(f"e{i}", [step] * (i % 5 + 1), i % 5 + 1) for i in range(150)], schema).coalesce(1)
    out = N.encode_online(rows, weights, ["entity_id"]).collect()
    assert sorted(r["chunk_rows"] for r in out) == [22] * 22 + [64] * 128 and all(r["latency_ms"] > 0 for r in out)
    assert len({r["latency_ms"] for r in out}) == 3
    whole = {r["entity_id"]: r["embedding"] for r in N.encode(rows, weights, ["entity_id"]).collect()}
    assert all(r["embedding"] == pytest.approx(whole[r["entity_id"]], abs=1e-5) for r in out)
    assert list(N.encode_one(weights, [step] * 3)) == pytest.approx(whole["e2"], abs=1e-5)
    with pytest.raises(ValueError, match="length"):
        N.encode_online(rows.drop("length"), weights, ["entity_id"])


def test_batches_of_processing_time(spark, tmp_path):
    good = {"entity_id": "e", "timestamp": "2025-01-01T00:00:00Z", "cloud": "AWS", "entity_type": "t", "namespace": "n", "metric_name": "m", "value": "1"}
    source = tmp_path / "in"
    schema = "payload string"
    for i, lines in enumerate(([json.dumps(good)] * 3 + ["no"], ["[", "{}"], [])):
        spark.createDataFrame([(x,) for x in lines], schema).coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    listener, seen = health.Health(), []
    spark.streams.addListener(listener)
    assert listener.error_rate == 0.0
    try:
        query = health.start(stream, lambda df, info: seen.append((df.count(), info["n_valid"], info["n_invalid"], info["source"])), str(tmp_path / "state"), "wire", seconds=0)
        query.processAllAvailable()
        query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(seen) == [(0, 0, 2, "wire"), (3, 3, 1, "wire")]
    assert (listener.received, listener.invalid, listener.error_rate) == (6, 3, 0.5)


class FakeSubscriber:
    def __init__(self) -> None:
        self.queue, self.acked = [f"m{i}" for i in range(7)], []

    def acknowledge(self, request: dict) -> None:
        self.acked += request["ack_ids"]

    def pull(self, request: dict, timeout: float):
        waiting = [m for m in self.queue if f"ack-{m}" not in self.acked][: request["max_messages"]]
        message = lambda m: type("R", (), {"ack_id": f"ack-{m}", "message": type("M", (), {"data": m.encode()})})
        return type("P", (), {"received_messages": [message(m) for m in waiting]})


def test_pubsub_acknowledges_with_the_next_poll():
    service = FakeSubscriber()
    client = adapters.PubSubClient({"subscription": "s"}, service)
    lines, at = client.poll(client.start(), 5)
    assert lines == ["m0", "m1", "m2", "m3", "m4"] and service.acked == []
    assert client.poll(client.start(), 5)[0] == lines  # after a failure they come again
    more, at = client.poll(at, 5)
    assert more == ["m5", "m6"] and len(service.acked) == 5
    assert client.poll(at, 5) == ([], []) and len(service.acked) == 7


def test_delivered_rows_are_counted(spark):
    assert sinks.kafka(spark.createDataFrame([("a",), ("b",)], "payload string"), "s", "t", format="noop") == 2
