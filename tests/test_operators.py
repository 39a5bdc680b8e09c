"""Sequences, corpus, augmentation, vectors, encoder, detection, sources and sinks."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.graph import components
from tidemark.operators import augment as A
from tidemark.operators import corpus as K
from tidemark.operators import detect as D
from tidemark.operators import encoder as N
from tidemark.operators import features as E
from tidemark.operators import sequences as Q
from tidemark.operators import vectors as V
from tidemark.sources import events as S
from tidemark.sources import sinks

T0 = dt.datetime(2025, 11, 11, 6)


def events(spark, n, entity="e"):
    rows = [(entity, T0 + dt.timedelta(minutes=i), "AWS", "Instances", "AWS/EC2", "cpu", float(i), i) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id string, timestamp timestamp_ntz, cloud string, entity_type string, namespace string, metric_name string, value double, seq long")


def test_windows(spark):
    rows = events(spark, 100)
    assert Q.sliding(rows, 32, 16).select("window_start").distinct().count() == 5
    assert {r["window_id"]: r["count"] for r in Q.tumbling(rows, 32).groupBy("window_id").count().collect()} == {0: 32, 1: 32, 2: 32, 3: 4}
    assert Q.sliding(events(spark, 31), 32, 16).count() == 0
    assert sorted(r["seq"] for r in Q.last_events(events(spark, 10), 3).collect()) == [7, 8, 9]


def test_vocabulary_and_padding(spark):
    rows = events(spark, 5).unionByName(events(spark, 2, "f").withColumn("cloud", F.lit(""))).unionByName(events(spark, 1, "g").withColumn("cloud", F.lit(None).cast("string")))
    vocab = E.vocabulary(rows)
    assert {(r["label"], r["idx"]) for r in vocab.where("column = 'cloud'").collect()} == {("", 1), ("AWS", 2)}
    encoded = E.encode(rows, vocab, E.metric_stats(rows))
    seqs = Q.padded(Q.as_sequences(Q.last_events(encoded, 5), ["entity_id"]), 5).collect()
    assert {r["entity_id"]: (r["length"], len(r["steps"])) for r in seqs} == {"e": (5, 5), "f": (2, 5), "g": (1, 5)}
    short = next(r for r in seqs if r["entity_id"] == "f")
    assert all(not any(s["num"]) and not any(s["cat"]) for s in short["steps"][2:])


def test_spline_reproduces_a_cubic(spark):
    x = np.arange(-1.0, 25.0)
    f = lambda t: 0.3 * t**3 - 2 * t**2 + t - 7
    at = np.linspace(-1, 24, 333)
    assert np.allclose(K.not_a_knot(x, f(x), at), f(at))


def test_linear_fill(spark):
    fill = lambda v: spark.createDataFrame([(v,)], "a array<double>").select(K.linear_fill(F.col("a")).alias("x")).first()["x"]
    assert fill([None, 2.0, None, 4.0] + [None] * 30) == [2.0, 2.0, 3.0] + [4.0] * 21
    assert fill([1.0]) == [1.0] * 24
    assert fill([]) == [None] * 24


def test_corpus_rows_and_injection(spark):
    seeds = S.synthetic_seeds(spark, "2024-01-01", "2024-01-01", resources=9)
    rows = K.build(seeds, S.synthetic_anchors(seeds), noise=0.0)
    assert rows.columns == C.CORPUS_COLUMNS and rows.count() == 9 * 1440
    base = spark.createDataFrame([("e", T0 + dt.timedelta(minutes=m), 1.0) for m in range(60)], "entity_id string, timestamp timestamp, value double")
    anchors = [("e", T0 + dt.timedelta(minutes=20), 10, 3.0, "spike"), ("e", T0 + dt.timedelta(minutes=25), 10, 0.5, "recovery"), ("e", T0 + dt.timedelta(days=1), 999, 9.0, "spike")]
    out = {r["timestamp"].minute: r for r in K.inject(base, spark.createDataFrame(anchors, "entity_id string, alert_ts timestamp, half int, factor double, anomaly_type string")).collect()}
    assert (out[9]["value"], out[10]["value"], out[20]["value"], out[35]["value"], out[36]["value"]) == (1.0, 3.0, 1.5, 0.5, 1.0)
    assert (out[12]["anomaly_type"], out[20]["anomaly_type"], out[50]["anomaly_type"]) == ("spike", "recovery", "")


def test_augmented_pairs(spark):
    wide = events(spark, 50).withColumns({c: F.lit(7.0) for c in C.WIDE_NUMERIC})
    pairs = A.pairs(wide, C.WIDE_NUMERIC).cache()
    assert K.pair_integrity(pairs).where("NOT ok").count() == 0
    joined = pairs.join(wide.select("seq", F.col("timestamp").alias("t0")), "seq").withColumn("off", F.abs(F.timestamp_diff("SECOND", F.col("t0"), F.col("timestamp"))))
    assert joined.where("off < 59 OR off > 300").count() == 0
    masked = sum((F.col(f"{c}_masked") for c in C.WIDE_NUMERIC), F.lit(0.0))
    assert {r["m"] for r in pairs.select(masked.alias("m")).distinct().collect()} <= {1.0, 2.0}
    assert pairs.where(" OR ".join(f"({c}_masked = 1) <> ({c} = 0)" for c in C.WIDE_NUMERIC)).count() == 0
    assert pairs.select(F.size(A.flat_vector(C.WIDE_NUMERIC)).alias("n")).distinct().first()["n"] == 22
    assert A.views(wide, per_row=2).groupBy("pair_id").count().where("count <> 2").count() == 0
    fresh = A.pairs(wide, C.WIDE_NUMERIC, epoch=1)
    assert fresh.select("pair_id", "view", "timestamp").subtract(pairs.select("pair_id", "view", "timestamp")).count() > 0


def unit_vectors(spark, n=40, d=8, entities=4):
    v = np.random.default_rng(3).standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, f"vm-{i % entities}", i, [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, entity_id string, seq long, embedding array<float>"), v


def test_search(spark):
    rows, _ = unit_vectors(spark)
    found = V.nearest(rows.where("vec_id < 5"), rows, k=5).collect()
    assert all(r["vec_id"] == r["query_id"] and abs(r["similarity"] - 1) < 1e-6 for r in found if r["rank"] == 1)
    others = V.nearest(rows.where("vec_id < 5"), rows, k=5, exclude_own=True).collect()
    assert len(others) == 25 and all(r["vec_id"] % 4 != r["query_id"] % 4 for r in others)
    assert V.nearest(rows.where("false"), rows).count() == 0


def test_profiles_and_folding(spark):
    rows, v = unit_vectors(spark)
    pooled = {r["entity_id"]: r["embedding"] for r in V.pool(rows).collect()}
    mean = v[0::4].mean(axis=0)
    assert np.allclose(pooled["vm-0"], mean / np.linalg.norm(mean), atol=1e-6)
    got = {r["entity_id"]: r for r in V.profiles(rows, n=30).collect()}
    assert got["vm-1"]["variance"] == pytest.approx(np.trace(np.cov(v[1::4], rowvar=False)), abs=1e-5)
    assert V.profiles(rows.where("vec_id = 0")).first()["variance"] == 0.0
    last = V.ema_update(V.profiles(rows.where("vec_id < 20")), rows.where("vec_id >= 20"), alpha=1.0)
    assert np.allclose({r["entity_id"]: r["centroid"] for r in last.collect()}["vm-3"], v[39], atol=1e-6)


def test_index_round_trip(spark, tmp_path):
    rows, _ = unit_vectors(spark, n=200)
    centres = V.train_cells(rows)
    V.build_index(rows.where("vec_id < 100"), str(tmp_path), centres)
    V.build_index(rows.where("vec_id >= 100"), str(tmp_path), centres, mode="append")
    indexed, again = V.load_index(spark, str(tmp_path))
    assert indexed.count() == 200 and np.allclose(again, centres)
    key = lambda df: {(r["query_id"], r["rank"], r["vec_id"]) for r in df.collect()}
    assert key(V.nearest_in_cells(rows.where("vec_id < 9"), indexed, again, probe=99)) == key(V.nearest(rows.where("vec_id < 9"), rows))


def test_encoder_is_unit_and_ignores_padding_and_chunks():
    w = N.seeded_weights([4, 5, 6, 7])
    draw = np.random.default_rng(0)
    num, ts = draw.standard_normal((6, 9, 3)).astype(np.float32), draw.random((6, 9)).astype(np.float32)
    cat, n = draw.integers(0, 4, (6, 9, 4)), np.array([9, 4, 1, 7, 2, 9])
    out = N.forward(w, num, cat, ts, n)
    assert out.shape == (6, C.EMBED_DIM) and np.allclose(np.linalg.norm(out, axis=1), 1, atol=1e-4)
    num[1, 4:], cat[1, 4:], ts[1, 4:] = 99, 3, 5
    assert np.allclose(N.forward(w, num, cat, ts, n), out, atol=1e-5)
    assert np.allclose(np.concatenate([N.forward(w, num[i : i + 2], cat[i : i + 2], ts[i : i + 2], n[i : i + 2]) for i in (0, 2, 4)]), out, atol=1e-5)
    assert np.allclose(N.forward(w, num[:1], cat[:1], ts[:1], n[:1], project=True).shape, (1, C.EMBED_DIM))
    assert {k: v.shape for k, v in N.load_weights(N.save_weights(w), strict=w).items()} == {k: v.shape for k, v in w.items()}
    with pytest.raises(ValueError):
        N.load_weights(N.save_weights({"a": np.zeros(1)}), strict=w)
    with pytest.raises(ValueError):
        N.collate([], np.array([]))


def test_loss_is_lower_for_matched_pairs(spark):
    _, v = unit_vectors(spark)
    pairs = lambda shift: spark.createDataFrame([(i, [float(x) for x in v[i]], [float(x) for x in v[(i + shift) % 8]]) for i in range(8)], "i int, a array<double>, b array<double>")
    assert 0 <= N.ntxent(pairs(0)).first()["loss"] < N.ntxent(pairs(1)).first()["loss"]


def test_latencies(spark):
    rows = spark.createDataFrame([(i, float(10 * i + 10)) for i in range(10)], "seq int, latency_ms double")
    assert tuple(N.latency_percentiles(rows).first()) == (10, 50.0, 100.0, 100.0)
    assert tuple(N.latency_percentiles(rows.where("false")).first()) == (0, 0.0, 0.0, 0.0)
    assert N.latency_percentiles(rows, cap=5).first()["n"] == 5


@pytest.mark.parametrize(("inputs", "score", "name"), [((0.4, 0.3, 0.8), 0.32, "MEDIUM"), ((1.0, 1.0, 1.0), 0.8, "CRITICAL"), ((0.0, 0.0, 0.0), 0.2, "LOW"), ((0.5, None, None), 0.6, "HIGH")])
def test_final_score(spark, inputs, score, name):
    s = D.final_score(*[F.lit(x).cast("double") for x in inputs])
    row = spark.range(1).select(F.round(s, 9).alias("s"), D.severity(F.round(s, 9)).alias("n")).first()
    assert (row["s"], row["n"]) == (pytest.approx(score), name)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(links).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 150: 100}


def test_documents_as_seeds_and_anchors(spark):
    at = dt.datetime(2024, 1, 2, 5)
    docs = spark.createDataFrame(
        [("", "i-1", None, None, "cpu", None, None, at, None, None, [{"Average": 1.0}] * 3), ("x", None, None, None, None, None, None, at, None, None, [{"Average": 1.0}] * 2)], S.SEED_DOC_SCHEMA
    )
    seeds = S.metric_seeds(docs, "2024-01-01", "2024-01-31").collect()
    assert [(r["entity_id"], r["cloud"], r["date"].hour) for r in seeds] == [("i-1", "AWS", 0)]
    alert = lambda rid, state, kind: ("monitoring", at, {"resource_id": rid, "alert_state": state, "metric_name": None, "type": kind, "severity": None})
    alerts = spark.createDataFrame([alert("a", "OK", "OK_TO_FIRING"), alert("b", "OK", None), alert("", "OK", ""), alert(None, "OK", "")], S.ALERT_SCHEMA)
    assert {(r["entity_id"], r["anomaly_type"]) for r in S.alert_anchors(alerts, "2024-01-01", "2024-01-31").collect()} == {("a", "spike"), ("b", "recovery")}


def test_feature_meta_and_registry(spark, tmp_path):
    text = json.dumps({"vocab_maps": {"cloud": {"AWS": 1}}, "metric_value_stats": {"cpu": {"mean": 50, "std": 10}, "mem": [1, 2]}})
    vocab, stats = S.feature_meta(spark, text)
    sinks.feature_meta(f"{tmp_path}/meta.json", vocab, stats)
    again = S.feature_meta(spark, (tmp_path / "meta.json").read_text())[1]
    assert {tuple(r) for r in again.collect()} == {("cpu", 50.0, 10.0), ("mem", 1.0, 2.0)}
    registry = sinks.Registry(f"{tmp_path}/manifest.json")
    with pytest.raises(LookupError):
        registry.latest()
    registry.register("0.10.0", {"weights_path": "a\\b"})
    registry.register("0.9.0", {"weights_path": "c"})
    assert registry.latest() == {"weights_path": "c"} and registry.get("0.10.0") == {"weights_path": "a/b"} and registry.versions() == ["0.10.0", "0.9.0"]


def test_sources_read_what_sinks_write(spark, tmp_path):
    rows = events(spark, 3).select("entity_id", "value")
    sinks.parquet(rows, f"{tmp_path}/p")
    sinks.json_lines(rows, f"{tmp_path}/j")
    rows.write.orc(f"{tmp_path}/o")
    rows.write.option("header", True).csv(f"{tmp_path}/c")
    schema = "entity_id string, value double"
    for got in (S.parquet(spark, f"{tmp_path}/p", ["entity_id", "value"]), S.json_lines(spark, f"{tmp_path}/j", schema), S.orc(spark, f"{tmp_path}/o"), S.csv(spark, f"{tmp_path}/c", schema)):
        assert sorted(map(tuple, got.collect())) == [("e", 0.0), ("e", 1.0), ("e", 2.0)]


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    sinks.parquet(events(spark, 3), f"{tmp_path}/p")
    plan = S.parquet(spark, f"{tmp_path}/p", ["entity_id", "value"]).where("value > 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<entity_id:string,value:double>" in plan and "GreaterThan(value,1.0)" in plan


def test_default_probe_finds_nine_tenths(spark):
    draw = np.random.default_rng(0)
    vecs = draw.standard_normal((2000, 16))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    rows = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, entity_id string, embedding array<float>")
    queries, centres = rows.where("vec_id % 50 = 0"), [v for v in vecs[:100]]
    indexed = V.assign_cells(rows, centres).withColumn("cell", F.element_at("cells", 1)).drop("cells")
    exact = {tuple(r) for r in V.nearest(queries, rows).select("query_id", "vec_id").collect()}
    share = lambda found: len(exact & {tuple(r) for r in found.select("query_id", "vec_id").collect()}) / len(exact)
    assert share(V.nearest_in_cells(queries, indexed, centres, probe=20)) < 0.9 <= share(V.nearest_in_cells(queries, indexed, centres))


def test_search_holds_no_queries_on_the_driver_and_ranks_copies_by_id(spark):
    """However many blocks there are, the plan is the same; of a group of copies larger than a part's best the least ids are found."""
    draw = np.random.default_rng(1)
    vecs = draw.standard_normal((60, 8))[np.arange(3000) % 60]
    rows = spark.createDataFrame([(i, f"vm-{i % 7}", [float(x) for x in v]) for i, v in zip(draw.permutation(3000).tolist(), vecs)], "vec_id long, entity_id string, embedding array<double>")
    queries, table = rows.where("vec_id % 50 = 0"), rows.toPandas()
    plans = [V.nearest(queries, rows, block=b)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for b in (4096, 1)]
    assert plans == [1, 1]
    matrix = np.stack(table["embedding"])
    for exclude in (False, True):
        got = V.nearest(queries, rows, k=5, exclude_own=exclude, block=4).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("r")).collect()
        assert len(got) == 60
        for r in got:
            asked = table[table["vec_id"] == r["query_id"]].iloc[0]
            d = ((matrix - asked["embedding"]) ** 2).sum(1)
            if exclude:
                d[table["entity_id"] == asked["entity_id"]] = np.inf
            assert [x["vec_id"] for x in r["r"]] == table["vec_id"].to_numpy()[np.lexsort((table["vec_id"], d))[:5]].tolist()


def test_cells_are_searched_in_parts_and_not_by_a_join_of_pairs(spark, monkeypatch):
    """A cell larger than a part is several of them; within the probed cells the search is exact; empty cells do no harm."""
    monkeypatch.setattr(V, "PART", 64)
    draw = np.random.default_rng(2)
    vecs = draw.standard_normal((1200, 8))
    vecs[600:900] = vecs[0]  # a hot vector and so a hot cell
    rows = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, entity_id string, embedding array<double>")
    centres = [*vecs[:6], np.full(8, 50.0)]
    near = np.argsort(((vecs[:, None] - np.array(centres)[None]) ** 2).sum(2), axis=1, kind="stable")
    indexed = V.assign_cells(rows, centres).withColumn("cell", F.element_at("cells", 1)).drop("cells").persist()
    for probe in (2, 7):
        found = V.nearest_in_cells(rows.where("vec_id % 50 = 0"), indexed, centres, k=5, probe=probe)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in found.collect()}
        assert len(got) == 24 * 5
        for q in range(0, 1200, 50):
            d = ((vecs - vecs[q]) ** 2).sum(1)
            d[~np.isin(near[:, 0], near[q, :probe])] = np.inf
            best = np.lexsort((np.arange(1200), d))[:5]
            assert [got[q, i + 1][0] for i in range(5)] == best.tolist() and np.allclose([got[q, i + 1][1] for i in range(5)], d[best])
    indexed.unpersist()


def test_index_has_a_file_or_a_few_for_each_cell(spark, tmp_path):
    """Not one for each cell and task: opening those took longer than reading them."""
    rows, v = unit_vectors(spark, n=400)
    V.build_index(rows.repartition(8), str(tmp_path), list(v[:10]))
    assert len(list((tmp_path / "vectors").rglob("*.parquet"))) <= 20
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 400


def test_training_sample_stays_where_the_vectors_are(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    rows, fit, seen = unit_vectors(spark, n=2000)[0].repartition(4).persist(), KMeans.fit, []
    monkeypatch.setattr(KMeans, "fit", lambda self, sample: seen.append((sample.rdd.getNumPartitions(), sample.count())) or fit(self, sample))
    assert len(V.train_cells(rows, cells=4)) == 4 and len(V.train_cells(rows.where("vec_id < 80"), cells=4)) == 2
    assert seen[0][0] == 4 and 200 <= seen[0][1] <= 200 + 12 * 200**0.5  # a tenth
    assert seen[1][1] == 80  # 39 a cell and six roots of that more, so all
    rows.unpersist()
