"""Embeddings: pooling, profiles, neighbours, deviation, drift and the encoder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.functions.scratch import cut, shared_dir
from tidemark.operators import detect as D
from tidemark.operators import encoder as N
from tidemark.operators import features as E
from tidemark.operators import profiles as P
from tidemark.operators import sequences as Q
from tidemark.operators import vectors as V
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.concat(F.lit("vm-"), F.col("label").cast("string")).alias("entity_id"), F.col("vec_id").alias("seq"), "embedding")


ASKED = "vec_id % 50 = 0"  # the stated query set of the searches
VECTORS = "SELECT vec_id, 'vm-' || label::VARCHAR AS entity_id, embedding FROM embeddings"
UNNEST = "SELECT vec_id, entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v"


@query(f"""WITH v AS ({VECTORS}), u AS ({UNNEST}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY vec_id)
SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0.0::DOUBLE AS x FROM u JOIN n USING (vec_id)""")
def emb_normalise(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(X.normalised(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", big("pos").alias("pos"), r6("x").alias("x"))


@query(f"""WITH v AS ({VECTORS}), u AS ({UNNEST}), m AS (SELECT entity_id, pos, avg(x) AS x, count(*) AS n_records FROM u GROUP BY ALL), n AS (SELECT entity_id, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL)
SELECT entity_id, pos, n_records, round(x / n, 6) + 0.0::DOUBLE AS x FROM m JOIN n USING (entity_id)""")
def emb_pool_entity(spark, sf_dir):
    rows = V.pool(vectors(spark, sf_dir)).select("entity_id", "n_records", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("entity_id", big("pos").alias("pos"), "n_records", r6("x").alias("x"))


@query(f"""WITH v AS ({VECTORS}) SELECT entity_id, count(*) AS n_records, CASE WHEN entity_id IN ('vm-0', 'vm-1', 'vm-2') THEN 'AWS' ELSE 'Unknown' END AS cloud_provider FROM v GROUP BY ALL""")
def emb_pool_cloud(spark, sf_dir):
    known = vectors(spark, sf_dir).select("entity_id").distinct().where(F.col("entity_id").isin("vm-0", "vm-1", "vm-2")).withColumn("cloud_provider", F.lit("AWS"))
    return V.with_cloud(V.pool(vectors(spark, sf_dir)), known).select("entity_id", "n_records", "cloud_provider")


_RECENT = f"v0 AS ({VECTORS}), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id DESC) AS b FROM v0) WHERE b <= 30)"
_PROFILE = f"{_RECENT}, u AS ({UNNEST}), m AS (SELECT entity_id, pos, avg(x) AS x, coalesce(var_samp(x), 0) AS s FROM u GROUP BY ALL), n AS (SELECT entity_id, sqrt(sum(x * x)) AS n, sum(s) AS variance FROM m GROUP BY ALL)"


@query(f"WITH {_PROFILE} SELECT entity_id, pos, round(x / n, 6) + 0.0::DOUBLE AS centroid, round(variance, 6) AS variance FROM m JOIN n USING (entity_id)")
def profile_centroid_variance(spark, sf_dir):
    rows = V.profiles(vectors(spark, sf_dir)).select("entity_id", "variance", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("entity_id", big("pos").alias("pos"), r6("x").alias("centroid"), r6("variance").alias("variance"))


@query(f"""WITH v AS ({VECTORS}), u AS ({UNNEST}), m AS (SELECT pos, avg(x) AS x FROM u GROUP BY pos), n AS (SELECT sqrt(sum(x * x)) AS n FROM m)
SELECT 'vm-' || e.e::VARCHAR AS entity_id, pos, round(x / n, 6) + 0.0::DOUBLE AS centroid, true AS cold_start FROM range(100, 103) e(e), m, n""")
def profile_cold_start(spark, sf_dir):
    entities = spark.range(100, 103).select(F.concat(F.lit("vm-"), F.col("id").cast("string")).alias("entity_id"))
    rows = V.cold_profiles(entities, vectors(spark, sf_dir)).select("entity_id", "cold_start", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("entity_id", big("pos").alias("pos"), r6("x").alias("centroid"), "cold_start")


@query(f"""
WITH RECURSIVE v AS ({VECTORS}), o AS (SELECT * FROM v WHERE vec_id % 3 <> 0), w AS (SELECT entity_id, embedding, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id) AS k FROM v WHERE vec_id % 3 = 0),
old AS (SELECT entity_id, embedding, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id DESC) AS b FROM o) WHERE b <= 30),
u AS (SELECT entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM old),
m AS (SELECT entity_id, pos, avg(x) AS x, coalesce(var_samp(x), 0) AS s FROM u GROUP BY ALL), n AS (SELECT entity_id, sqrt(sum(x * x)) AS n, sum(s) AS variance FROM m GROUP BY ALL),
p AS (SELECT entity_id, any_value(variance) AS variance, list(x / n ORDER BY pos) AS c FROM m JOIN n USING (entity_id) GROUP BY entity_id),
f AS (SELECT entity_id, variance, c, 0::BIGINT AS k, 0::DOUBLE AS far FROM p UNION ALL
  SELECT f.entity_id, f.variance, list_transform(list_zip(f.c, w.embedding), lambda z: 0.9::DOUBLE * z[1] + 0.1::DOUBLE * z[2]::DOUBLE), w.k,
    greatest(f.far, sqrt(list_sum(list_transform(list_zip(f.c, w.embedding), lambda z: (z[1] - z[2]::DOUBLE) * (z[1] - z[2]::DOUBLE))))) FROM f JOIN w ON w.entity_id = f.entity_id AND w.k = f.k + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) AS r FROM f)
SELECT entity_id, far > 3 * sqrt(variance) AS drift_alarm, round(far, 6) AS max_distance, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS first FROM l WHERE r = 1 AND k > 0""")
def profile_ema_drift(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    prior = V.profiles(rows.where("vec_id % 3 <> 0"))
    out = V.ema_update(prior, rows.where("vec_id % 3 = 0"))
    return out.select("entity_id", "drift_alarm", r6("max_distance").alias("max_distance"), r6(F.get("centroid", F.lit(0))).alias("first"))


@query(f"""
WITH RECURSIVE v AS ({VECTORS}), o AS (SELECT * FROM v WHERE vec_id % 3 <> 0 AND entity_id NOT IN ('vm-8', 'vm-9')),
w AS (SELECT entity_id, embedding, vec_id, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id) AS k FROM v WHERE vec_id % 3 = 0 AND entity_id NOT IN ('vm-8', 'vm-9')),
old AS (SELECT entity_id, embedding, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id DESC) AS b FROM o) WHERE b <= 30),
u AS (SELECT entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM old),
m AS (SELECT entity_id, pos, avg(x) AS x, coalesce(var_samp(x), 0) AS s FROM u GROUP BY ALL), n AS (SELECT entity_id, sqrt(sum(x * x)) AS n, sum(s) AS variance FROM m GROUP BY ALL),
p AS (SELECT entity_id, any_value(variance) AS variance, list(x / n ORDER BY pos) AS c FROM m JOIN n USING (entity_id) GROUP BY entity_id),
f AS (SELECT entity_id, variance, c, 0::BIGINT AS k, 0::DOUBLE AS far FROM p UNION ALL
  SELECT f.entity_id, f.variance, list_transform(list_zip(f.c, w.embedding), lambda z: 0.9::DOUBLE * z[1] + 0.1::DOUBLE * z[2]::DOUBLE), w.k,
    greatest(f.far, sqrt(list_sum(list_transform(list_zip(f.c, w.embedding), lambda z: (z[1] - z[2]::DOUBLE) * (z[1] - z[2]::DOUBLE))))) FROM f JOIN w ON w.entity_id = f.entity_id AND w.k = f.k + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) AS r FROM f),
h AS (SELECT entity_id, embedding, 0 AS late, vec_id FROM old UNION ALL SELECT entity_id, embedding, 1, vec_id FROM w),
h30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY late DESC, vec_id DESC) AS b FROM h) WHERE b <= 30),
hv AS (SELECT entity_id, sum(s) AS variance, max(n) AS n FROM (SELECT entity_id, pos, var_samp(x) AS s, count(*) AS n FROM (SELECT entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM h30) GROUP BY ALL) GROUP BY entity_id),
f30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id DESC) AS b FROM v WHERE entity_id IN ('vm-8', 'vm-9')) WHERE b <= 30),
fm AS (SELECT entity_id, pos, avg(x) AS x, var_samp(x) AS s, count(*) AS n FROM (SELECT entity_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM f30) GROUP BY ALL)
SELECT entity_id, far > 3 * sqrt(l.variance) AS drift_alarm, hv.n AS n_records, round(hv.variance, 6) AS variance, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS first FROM l JOIN hv USING (entity_id) WHERE r = 1 AND k > 0
UNION ALL SELECT entity_id, false, max(n), round(sum(s), 6), round(max(CASE WHEN pos = 1 THEN x END) / sqrt(sum(x * x)), 6) FROM fm GROUP BY entity_id""")
def profile_incremental(spark, sf_dir):
    """New vectors folded into stored profiles; vm-8 has no profile and vm-9 nothing new, so both are built in full."""
    rows = vectors(spark, sf_dir)
    store = P.EntityStore(spark, f"{shared_dir(spark)}/tidemark/profiles-{uuid.uuid4().hex}")
    known = rows.select("entity_id").distinct()
    store.write(P.full_build(rows.where("vec_id % 3 <> 0 AND entity_id <> 'vm-8'"), known.where("entity_id <> 'vm-8'")))
    alarms = P.update(store, rows.where("vec_id % 3 = 0 AND entity_id <> 'vm-9'"), known, rows)
    out = store.read().join(alarms, "entity_id")
    return out.select("entity_id", "drift_alarm", big("n_records").alias("n_records"), r6("variance").alias("variance"), r6(F.get("centroid", F.lit(0))).alias("first"))


@query(f"""WITH {_PROFILE}, c AS (SELECT entity_id, count(*) AS n_records FROM v GROUP BY ALL), au AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v0),
am AS (SELECT pos, avg(x) AS x FROM au GROUP BY pos)
SELECT entity_id, n_records, round(variance, 6) AS variance, round(x / n, 6) + 0.0::DOUBLE AS first, false AS cold_start FROM m JOIN n USING (entity_id) JOIN c USING (entity_id) WHERE pos = 0
UNION ALL SELECT 'vm-100', 0, 0.0, (SELECT round(max(CASE WHEN pos = 0 THEN x END) / sqrt(sum(x * x)), 6) + 0.0::DOUBLE FROM am), true""")
def profile_refresh(spark, sf_dir):
    """Every known entity built anew: those of the store, one of them out of date, and one without vectors."""
    rows = vectors(spark, sf_dir)
    store = P.EntityStore(spark, f"{shared_dir(spark)}/tidemark/profiles-{uuid.uuid4().hex}")
    store.write(P.full_build(rows.where("entity_id = 'vm-3' AND vec_id % 7 = 0"), rows.where("entity_id = 'vm-3'").select("entity_id")))
    lone = spark.range(1).select(F.lit("vm-100").alias("entity_id"))
    P.refresh(store, rows, rows.where("entity_id <> 'vm-3'").select("entity_id").unionByName(lone))
    return store.read().select("entity_id", big("n_records").alias("n_records"), r6("variance").alias("variance"), r6(F.get("centroid", F.lit(0))).alias("first"), "cold_start")


def _knn_sql(where: str = "", exclude: bool = False) -> str:
    return f"""WITH v AS ({VECTORS}), d AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d
    FROM v q CROSS JOIN v c WHERE q.vec_id % 50 = 0 {"AND q.entity_id <> c.entity_id" if exclude else ""})
    SELECT query_id, rank, vec_id, round(d, 6) + 0.0::DOUBLE AS distance, round(1 - d / 2, 6) + 0.0::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) WHERE rank <= 10"""


def _knn(found):
    return found.select("query_id", big("rank").alias("rank"), "vec_id", r6("distance").alias("distance"), r6("similarity").alias("similarity"))


@query(_knn_sql())
def knn_top10(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _knn(V.nearest(rows.where(ASKED), rows))


@query(_knn_sql(exclude=True))
def knn_exclude_self_entity(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _knn(V.nearest(rows.where(ASKED), rows, exclude_own=True))


@query("SELECT 10 * count(*) AS n, true AS same FROM embeddings WHERE vec_id % 50 = 0")
def knn_batch_equals_single(spark, sf_dir):
    """The queries in one block and in blocks of 4 give the same rows."""
    rows = vectors(spark, sf_dir)
    queries = rows.where(ASKED)
    one, many = (V.nearest(queries, rows, block=b).select("query_id", "rank", "vec_id") for b in (V.BROADCAST_QUERIES, 4))
    both = one.withColumn("one", F.lit(1)).join(many.withColumn("many", F.lit(1)), ["query_id", "rank", "vec_id"], "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.every(F.col("one").isNotNull() & F.col("many").isNotNull()), F.lit(True)).alias("same"))


def _indexed(rows):
    centres = V.train_cells(rows)
    return V.assign_cells(rows, centres).withColumn("cell", F.element_at("cells", 1)).drop("cells"), centres


@query(_knn_sql())
def knn_ivf_all_cells(spark, sf_dir):
    """The search by cells is exact when it looks into all of them."""
    rows = vectors(spark, sf_dir)
    indexed, centres = _indexed(rows)
    return _knn(V.nearest_in_cells(rows.where(ASKED), indexed, centres, probe=len(centres)))


@query()
def knn_ivf_recall(spark, sf_dir):
    """What the search by cells finds of the exact neighbours, with half of the cells and by default."""
    rows = vectors(spark, sf_dir)
    queries = rows.where(ASKED)
    indexed, centres = _indexed(rows)
    exact = cut(V.nearest(queries, rows).select("query_id", "vec_id"), "exact")
    wanted = exact.agg(F.count(F.lit(1)).alias("n"))
    recall = lambda probe, name: V.nearest_in_cells(queries, indexed, centres, probe=probe).select("query_id", "vec_id").join(exact, ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias(name))
    found = wanted.crossJoin(recall(max(1, len(centres) // 2), "half")).crossJoin(recall(None, "default"))  # one row each
    return found.select((F.col("half") / F.col("n")).alias("recall_half"), (F.col("default") / F.col("n")).alias("recall_default"))


_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY vec_id DESC) AS b2 FROM v0) WHERE b2 = 1)"


@query(f"""WITH {_PROFILE}, {_CURRENT}, cen AS (SELECT entity_id, list(x / n ORDER BY pos) AS c FROM m JOIN n USING (entity_id) GROUP BY entity_id),
dot AS (SELECT c.entity_id, 1 - list_sum(list_transform(list_zip(c.embedding, e.c), lambda z: z[1]::DOUBLE * z[2])) AS g FROM cur c JOIN cen e USING (entity_id)),
loc AS (SELECT c.entity_id, avg(1 - list_sum(list_transform(list_zip(c.embedding, h.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS l FROM cur c JOIN v h USING (entity_id) GROUP BY c.entity_id)
SELECT entity_id, round(g, 6) + 0.0::DOUBLE AS global_deviation, round(l, 6) + 0.0::DOUBLE AS local_deviation, round(greatest(g, l), 6) + 0.0::DOUBLE AS deviation, g > 0.3 AS global_flag, l > 0.25 AS local_flag FROM dot JOIN loc USING (entity_id)""")
def cosine_deviation(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = D.deviation(V.last_vectors(rows, "entity_id", "seq", 1), V.profiles(rows))
    return out.select("entity_id", *[r6(c).alias(c) for c in ("global_deviation", "local_deviation", "deviation")], "global_flag", "local_flag")


_SIDES = "s AS (SELECT entity_id, embedding, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'now' ELSE 'past' END AS side FROM v0), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, side ORDER BY vec_id DESC) AS b FROM s) WHERE b <= 200)"


@query(f"""WITH v0 AS ({VECTORS}), {_SIDES},
p AS (SELECT a.entity_id, a.side AS s1, b.side AS s2, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d
  FROM k a JOIN k b ON a.entity_id = b.entity_id AND (a.side < b.side OR a.side = b.side AND a.vec_id < b.vec_id)),
g AS (SELECT entity_id, median(sqrt(d)) / sqrt(2) AS sigma FROM p GROUP BY entity_id),
e AS (SELECT p.entity_id, s1, s2, exp(-d / (2 * sigma * sigma)) AS kv, sigma FROM p JOIN g USING (entity_id))
SELECT entity_id, round(any_value(sigma), 6) AS sigma, round(avg(kv) FILTER (s1 = 'now' AND s2 = 'now') + avg(kv) FILTER (s1 = 'past' AND s2 = 'past') - 2 * avg(kv) FILTER (s1 = 'now' AND s2 = 'past'), 6) + 0.0::DOUBLE AS mmd2 FROM e GROUP BY entity_id""")
def mmd_drift(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("entity_id", F.when(F.col("vec_id") % 2 == 0, "now").otherwise("past").alias("side"), F.col("vec_id").alias("id"), "embedding")
    return D.mmd(rows).select("entity_id", r6("sigma").alias("sigma"), r6("mmd2").alias("mmd2"))


@query()
def drift_scores(spark, sf_dir):
    """mmd2 by the 99th percentile of 1,000 random halves of each entity's past."""
    rows = vectors(spark, sf_dir).select("entity_id", F.when(F.col("vec_id") % 2 == 0, "now").otherwise("past").alias("side"), F.col("vec_id").alias("id"), "embedding")
    null = D.mmd_null(rows.where("side = 'past'"))
    return D.drift_score(D.mmd(rows), null).select("entity_id", r6("drift").alias("drift"), "drift_flag")


@query(f"""WITH v AS ({VECTORS}), a0 AS (SELECT vec_id // 64 AS batch, vec_id % 32 AS i, vec_id % 64 // 32 AS view, embedding AS e FROM v),
a AS (SELECT x.* FROM a0 x JOIN a0 y ON x.batch = y.batch AND x.i = y.i AND x.view <> y.view),
s AS (SELECT x.batch, x.i, x.view, y.i AS j, list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / 0.07::DOUBLE AS s FROM a x JOIN a y ON x.batch = y.batch AND (x.i <> y.i OR x.view <> y.view)),
r AS (SELECT batch, i, view, ln(sum(exp(s - 1 / 0.07::DOUBLE))) + 1 / 0.07::DOUBLE - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY ALL) SELECT batch, round(avg(l), 6) AS loss FROM r GROUP BY batch""")
def ntxent_loss(spark, sf_dir):
    """The loss of every batch of 64 vectors, the first half of a batch matched with the second."""
    rows = vectors(spark, sf_dir).select(F.expr("vec_id div 64").alias("batch"), (F.col("vec_id") % 32).alias("i"), F.expr("vec_id % 64 div 32").alias("view"), "embedding")
    a, b = (rows.where(F.col("view") == k).select("batch", "i", F.col("embedding").alias("ab"[k])) for k in (0, 1))
    return N.ntxent(a.join(b, ["batch", "i"]), batch="batch").select("batch", r6("loss").alias("loss"))


@query()
def encode_forward(spark, sf_dir):
    records = S.records(table(spark, sf_dir, "events"))
    vocab = E.vocabulary(records)
    sizes = {r["column"]: r["n"] + 1 for r in vocab.groupBy("column").agg(F.max("idx").alias("n")).collect()}
    encoded = E.encode(records, vocab, E.metric_stats(records))
    sequences = Q.as_sequences(Q.last_events(encoded), ["entity_id"])
    out = N.encode(sequences, N.seeded_weights([sizes[c] for c in C.CATEGORICAL]), ["entity_id"])
    return out.select("entity_id", big(F.size("embedding")).alias("width"), F.round(X.norm(F.col("embedding")), 4).alias("norm"))


@query()
def profile_full_build(spark, sf_dir):
    """Windows of 32 events of the last 90 days, encoded, the last 30 made into a profile."""
    records = S.records(table(spark, sf_dir, "events"))
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    recent = P.look_back(records, as_of)
    vocab = E.vocabulary(recent)
    sizes = {r["column"]: r["n"] + 1 for r in vocab.groupBy("column").agg(F.max("idx").alias("n")).collect()}
    windows = Q.tumbling(E.encode(recent, vocab, E.metric_stats(recent)))
    sequences = Q.as_sequences(windows, ["entity_id", "window_id"])
    vecs = N.encode(sequences, N.seeded_weights([sizes[c] for c in C.CATEGORICAL]), ["entity_id", "window_id"])
    return V.profiles(vecs, order="window_id").select("entity_id", "n_records", r6("variance").alias("variance"), "cold_start")


@query("""WITH s AS (SELECT value::DOUBLE AS x, event_id FROM events ORDER BY event_id DESC LIMIT 10000), l AS (SELECT list(x ORDER BY x) AS a, count(*) AS n FROM s)
SELECT n, a[round_even(50 / 100.0::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p50, a[round_even(95 / 100.0::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p95, a[round_even(99 / 100.0::DOUBLE * (n - 1), 0)::BIGINT + 1] AS p99 FROM l""")
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("latency_ms"), F.col("event_id").alias("seq"))
    return N.latency_percentiles(rows).withColumn("n", big("n"))
