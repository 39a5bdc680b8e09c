"""Vocabularies, statistics, encoded records and sequences over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.operators import augment as A
from tidemark.operators import features as E
from tidemark.operators import sequences as Q
from tidemark.plans.ingest_queries import CLOUD, KIND
from tidemark.plans.registry import big, query, r6, table
from tidemark.sources import events as S

RECORDS = f"SELECT user_id::VARCHAR AS entity_id, ts, {CLOUD} AS cloud, {KIND} AS entity_type, {CLOUD} || '/' || event_type AS namespace, event_type AS metric_name, value, event_id AS seq FROM events"
LABELS = " UNION ".join(f"SELECT '{c}' AS \"column\", {c} AS label FROM r" for c in C.CATEGORICAL)
VOCAB = f"SELECT \"column\", label, row_number() OVER (PARTITION BY \"column\" ORDER BY label) AS idx FROM ({LABELS})"
STATS = "SELECT metric_name, avg(coalesce(value, 0)) AS mean, greatest(stddev_pop(coalesce(value, 0)), 1e-6::DOUBLE) AS std FROM r GROUP BY metric_name"
ORDERED = "ORDER BY ts, metric_name, seq"


def _records(spark, sf_dir):
    return S.records(table(spark, sf_dir, "events"))


def _without_gcp(records):
    """A vocabulary that lacks a provider, so that there are unknown labels."""
    return E.vocabulary(records.where(F.col("cloud") != "GCP"))


def _encoded(spark, sf_dir):
    records = _records(spark, sf_dir)
    return E.encode(records, _without_gcp(records), E.metric_stats(records))


@query(f"WITH r AS ({RECORDS}) {VOCAB}")
def vocab_maps(spark, sf_dir):
    return E.vocabulary(_records(spark, sf_dir)).withColumn("idx", big("idx"))


@query(f"WITH r AS ({RECORDS}), s AS ({STATS}) SELECT metric_name, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def metric_stats(spark, sf_dir):
    return E.metric_stats(_records(spark, sf_dir)).select("metric_name", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH r AS ({RECORDS}) SELECT metric_name, round(avg(value), 6) AS mean, round(CASE WHEN coalesce(stddev_samp(value), 0) <= 1e-6 THEN 1 ELSE stddev_samp(value) END, 6) AS std FROM r GROUP BY metric_name")
def metric_stats_sample(spark, sf_dir):
    return E.sample_stats(_records(spark, sf_dir)).select("metric_name", r6("mean").alias("mean"), r6("std").alias("std"))


_ENCODED = f"""WITH all_r AS ({RECORDS}), r AS (SELECT * FROM all_r WHERE cloud <> 'GCP'), v AS ({VOCAB}), s AS ({STATS.replace("FROM r", "FROM all_r")}),
e AS (SELECT a.*, {", ".join(f"coalesce(v{i}.idx, 0) AS {c}_idx" for i, c in enumerate(C.CATEGORICAL))}, (value - mean) / (std + 1e-6::DOUBLE) AS value_norm,
  (hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE) / 24 AS hour_frac, hour(ts) / 24.0::DOUBLE AS hour_of_day, (isodow(ts) - 1) / 7.0::DOUBLE AS day_of_week
  FROM all_r a {" ".join(f"LEFT JOIN v v{i} ON v{i}.column = '{c}' AND v{i}.label = a.{c}" for i, c in enumerate(C.CATEGORICAL))} JOIN s USING (metric_name))"""
_COLUMNS = [f"{c}_idx" for c in C.CATEGORICAL]


@query(f"{_ENCODED} SELECT seq, {', '.join(_COLUMNS)}, round(value_norm, 6) AS value_norm, round(hour_frac + 1e-9::DOUBLE, 6) AS hour_frac, round(hour_of_day, 6) AS hour_of_day, round(day_of_week, 6) AS day_of_week FROM e")
def encode_records(spark, sf_dir):
    floats = ["value_norm", "hour_frac", "hour_of_day", "day_of_week"]
    return _encoded(spark, sf_dir).select("seq", *[big(c).alias(c) for c in _COLUMNS], *[r6(F.col(c) + (1e-9 if c == "hour_frac" else 0.0)).alias(c) for c in floats])


@query(f"{_ENCODED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c}_idx = 0) AS oov FROM e" for c in C.CATEGORICAL))
def oov_counts(spark, sf_dir):
    return E.unknown_counts(_encoded(spark, sf_dir))


_LAST = f"""SELECT entity_id, seq, row_number() OVER (PARTITION BY entity_id {ORDERED}) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, metric_name DESC, seq DESC) AS back FROM r) WHERE back <= 32"""


@query(f"WITH r AS ({RECORDS}) {_LAST}")
def sequence_last_l(spark, sf_dir):
    return Q.last_events(_records(spark, sf_dir)).select("entity_id", "seq", big("pos").alias("pos"))


@query(f"WITH r AS ({RECORDS}) SELECT entity_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY entity_id {ORDERED}) AS n FROM r) WHERE n <= 20")
def sequence_first_n(spark, sf_dir):
    return Q.first_events(_records(spark, sf_dir), 20).select("entity_id", "seq")


@query(f"""{_ENCODED}, l AS ({_LAST.replace("FROM r)", "FROM all_r)")}), n AS (SELECT entity_id, count(*) AS length FROM l GROUP BY entity_id)
SELECT n.entity_id, g.pos::BIGINT AS pos, n.length, coalesce(round(e.value_norm::FLOAT::DOUBLE, 4), 0) AS value_norm, coalesce(e.metric_name_idx, 0) AS metric_idx
FROM n, range(32) g(pos) LEFT JOIN l ON l.entity_id = n.entity_id AND l.pos = g.pos LEFT JOIN e ON e.seq = l.seq""".replace("FROM n, range(32) g(pos) LEFT JOIN l", "FROM n CROSS JOIN range(32) g(pos) LEFT JOIN l"))
def sequence_padded(spark, sf_dir):
    last = Q.last_events(_encoded(spark, sf_dir))
    rows = Q.padded(Q.as_sequences(last, ["entity_id"]), C.SEQUENCE)
    rows = rows.select("entity_id", big("length").alias("length"), F.posexplode("steps").alias("pos", "s"))
    value = F.round(F.get("s.num", F.lit(0)).cast("double"), 4) + F.lit(0.0)
    return rows.select("entity_id", big("pos").alias("pos"), "length", value.alias("value_norm"), big(F.get("s.cat", F.lit(3))).alias("metric_idx"))


@query(f"WITH r AS ({RECORDS}), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id {ORDERED}) - 1 AS rn FROM r) SELECT entity_id, seq, rn // 32 AS window_id, rn % 32 AS pos FROM n")
def windows_tumbling32(spark, sf_dir):
    return Q.tumbling(_records(spark, sf_dir)).select("entity_id", "seq", big("window_id").alias("window_id"), big("pos").alias("pos"))


@query(f"""
WITH r AS ({RECORDS}), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id {ORDERED}) - 1 AS rn, count(*) OVER (PARTITION BY entity_id) AS total FROM r),
starts AS (SELECT DISTINCT entity_id, unnest(generate_series(0, total - 32, 16)) AS window_start FROM n WHERE total >= 32)
SELECT n.entity_id, n.seq, s.window_start, n.rn - s.window_start AS pos FROM n JOIN starts s ON n.entity_id = s.entity_id AND n.rn BETWEEN s.window_start AND s.window_start + 31""")
def windows_sliding32_16(spark, sf_dir):
    return Q.sliding(_records(spark, sf_dir)).select("entity_id", "seq", big("window_start").alias("window_start"), big("pos").alias("pos"))


def shifted_pairs(records):
    """Views that follow from event numbers: b is a, some minutes later; users divisible by 10 have no view b."""
    rows = A.views(records)
    later = F.timestamp_add("MINUTE", (F.col("seq") % 5 + 1).cast("int"), F.col("timestamp"))
    rows = rows.withColumn("timestamp", F.when(F.col("view") == "b", later).otherwise(F.col("timestamp")))
    return rows.where((F.col("view") == "a") | (F.col("entity_id").cast("int") % 10 != 0))


_PAIRS = f"""pairs AS (SELECT *, seq AS pair_id, 'a' AS view FROM r UNION ALL
  SELECT entity_id, ts + to_minutes(seq % 5 + 1), cloud, entity_type, namespace, metric_name, value, seq, seq AS pair_id, 'b' AS view FROM r WHERE entity_id::INT % 10 <> 0)"""


@query(f"""
WITH r AS ({RECORDS}), {_PAIRS},
n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, view ORDER BY pair_id, ts, metric_name) - 1 AS rn FROM pairs),
m AS (SELECT a.entity_id, a.rn, a.pair_id AS pair_id_a, b.pair_id AS pair_id_b, a.value AS value_a, b.value AS value_b, count(*) OVER (PARTITION BY a.entity_id) AS total
      FROM n a JOIN n b ON a.entity_id = b.entity_id AND a.rn = b.rn AND a.view = 'a' AND b.view = 'b'),
starts AS (SELECT DISTINCT entity_id, unnest(generate_series(0, total - 32, 16)) AS window_start FROM m WHERE total >= 32)
SELECT m.entity_id, s.window_start, m.rn - s.window_start AS pos, pair_id_a, pair_id_b, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b
FROM m JOIN starts s ON m.entity_id = s.entity_id AND m.rn BETWEEN s.window_start AND s.window_start + 31""")
def pair_windows(spark, sf_dir):
    out = Q.pair_windows(shifted_pairs(_records(spark, sf_dir)))
    return out.select("entity_id", big("window_start").alias("window_start"), big("pos").alias("pos"), "pair_id_a", "pair_id_b", r6("value_a").alias("value_a"), r6("value_b").alias("value_b"))


@query(f"""
WITH t AS (SELECT event_id AS seq, hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE AS h FROM events)
SELECT seq, round(h, 6) AS t0, {", ".join(f"round(sin(2 * pi() * {k} * h / 24), 6) + 0.0::DOUBLE AS t{k}" for k in range(1, 8))} FROM t""")
def time2vec_fixed(spark, sf_dir):
    rows = _records(spark, sf_dir).select("seq", X.time2vec(X.fractional_hour(F.col("timestamp"))).alias("v"))
    return rows.select("seq", *[r6(F.get("v", F.lit(k))).alias(f"t{k}") for k in range(C.TIME2VEC)])


_W, _P = [0.5, 0.9, 1.7, 2.6], [0.1, 0.2, -0.3, 0.4]


@query(f"""
WITH t AS (SELECT event_id AS seq, (hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE) / 24 AS h FROM events)
SELECT seq, round(h * {_W[0]}::DOUBLE + {_P[0]}::DOUBLE + 1e-9::DOUBLE, 6) AS t0, {", ".join(f"round(sin(h * {_W[k]}::DOUBLE + {_P[k]}::DOUBLE), 6) + 0.0::DOUBLE AS t{k}" for k in range(1, 4))} FROM t""")
def time2vec_learned(spark, sf_dir):
    tau = X.fractional_hour(F.col("timestamp")) / F.lit(24.0)
    rows = _records(spark, sf_dir).select("seq", X.learned_time2vec(tau, _W, _P).alias("v"))
    return rows.select("seq", *[r6(F.get("v", F.lit(k)) + (0.0 if k else 1e-9)).alias(f"t{k}") for k in range(4)])


@query(f"WITH r AS ({RECORDS}), {_PAIRS} SELECT pair_id, count(*) AS n, count(*) = 2 AND count(DISTINCT view) = 2 AS ok FROM pairs GROUP BY pair_id")
def pair_integrity(spark, sf_dir):
    from tidemark.operators import corpus

    return corpus.pair_integrity(shifted_pairs(_records(spark, sf_dir)))


@query(f"WITH r AS ({RECORDS}), {_PAIRS} SELECT a.pair_id, (abs(epoch_us(b.ts) - epoch_us(a.ts)) // 1000000)::BIGINT AS seconds FROM pairs a JOIN pairs b ON a.pair_id = b.pair_id AND a.view = 'a' AND b.view = 'b'")
def jitter_stats(spark, sf_dir):
    from tidemark.operators import corpus

    return corpus.pair_offsets(shifted_pairs(_records(spark, sf_dir)))


@query("SELECT 'event_type' AS \"column\", count(*) FILTER (event_type IS NULL) AS nulls, count(DISTINCT event_type) AS \"distinct\" FROM events UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL), count(DISTINCT user_id) FROM events UNION ALL SELECT 'props', count(*) FILTER (props IS NULL), count(DISTINCT props) FROM events")
def null_profile(spark, sf_dir):
    from tidemark.operators import corpus

    return corpus.null_profile(table(spark, sf_dir, "events"), ["event_type", "user_id", "props"])


@query("SELECT coalesce(string_agg(t, ',' ORDER BY t), '') AS outside FROM (SELECT DISTINCT event_type AS t FROM events WHERE event_type NOT IN ('click', 'view'))")
def value_domain(spark, sf_dir):
    from tidemark.operators import corpus

    return corpus.outside(table(spark, sf_dir, "events"), "event_type", ["click", "view"]).select(F.array_join("values", ",").alias("outside"))


def _wide(records):
    """Six metrics of a wide record that follow from the value."""
    return records.withColumns({c: F.col("value") * (i + 1) for i, c in enumerate(C.WIDE_NUMERIC)})


@query()
def aug_jitter(spark, sf_dir):
    rows = A.jitter(A.views(_records(spark, sf_dir)))
    return rows.select("pair_id", "view", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), r6("hour_of_day").alias("hour_of_day"))


@query()
def aug_mask(spark, sf_dir):
    rows = A.pairs(_wide(_records(spark, sf_dir)), C.WIDE_NUMERIC)
    return rows.select("pair_id", "view", *[f"{c}_masked" for c in C.WIDE_NUMERIC], big(F.size(A.flat_vector(C.WIDE_NUMERIC))).alias("width"))
