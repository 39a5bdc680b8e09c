"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source has a weight and a target: its share of the budget, at most ``cap`` times its size, with what a capped
source leaves shared by weight among the others. A source's documents are shuffled by hash and queued, ``cap`` rounds
of them one after the other. A queued document's virtual finish time is its source's tokens up to its end divided by
the source's target. At virtual time 1 a source has had its target; a document that is being served then is cut in two
there, so the first part finishes at 1. All queues are range-sorted by finish time and served until the budget is used
up; the last document served may be cut. So each source gets its target to within a word, and some words more where
targets are no whole numbers.

Running totals never gather a source in one task: hash order is cut into bins, bins are summed, and a total is its
bin's offset plus a sum in the bin; the global order is cut into Spark's range partitions in the same way.

Null text has no words; a document without words is never taken. A null source is a source of its own, ordered last.
Repeated rows are queued each for itself. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut

RANGE = 500_000  # documents in a range of the global order, about
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: int, share: float) -> DataFrame:
    """Return (rank, source, source_size, target, budget) of each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))})
    every = Window.partitionBy()
    sources = sources.withColumn("budget", F.floor(F.sum("source_size").over(every) * F.lit(float(share))))
    # In the order in which sources reach their cap: the level of tokens a unit of weight if all before are capped.
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / rest)
    held = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("most", "level"))
    first = F.min(F.when(held.isNotNull(), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    level = F.coalesce(first.getField("level"), F.lit(float("inf")))
    return sources.select("rank", "source", "source_size", "budget", F.least("most", F.col("weight") * level).alias("target"))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Return (doc_id, source, size, source_size, target, taken) of each document.

    ``weights`` go to the sources in code point order and repeat; ``share`` is the budget as a part of all words.
    ``taken`` counts repeats: a document is taken up to ``cap`` times.
    """
    if cap < 1 or min(weights) <= 0:
        raise ValueError("cap and weights must be positive")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("long")
    sized = docs.select("doc_id", "source", words_in("text").alias("size"), key.alias("key"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    count = sized.count()
    bins = max(1, math.isqrt(count))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), cap * count // RANGE)

    targets = cut(source_targets(sized, weights, cap, share), "targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = cut(rows.withColumn("bin", F.floor(F.col("key") / F.lit((1 << 60) / bins))), "ranked")

    # Tokens of a source up to and with each document, in hash order.
    ahead = Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("rank", "bin").agg(F.sum("size").alias("in_bin"))
    offsets = cut(offsets.select("rank", "bin", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)).alias("offset")), "offsets")
    in_bin = Window.partitionBy("rank", "bin").orderBy("key", "doc_id", "size", "row")
    upto = F.col("offset") + F.sum("size").over(in_bin)
    queued = rows.join(offsets, ["rank", "bin"]).withColumn("upto", upto).where("size > 0 AND target > 0")
    queued = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    end = F.col("upto") + F.col("round") * F.col("source_size")
    # The words that the source's target still has for a document; the first part of one that has more is cut off there.
    owed = F.floor("target") - end + F.col("size")
    parts = F.when((owed > 0) & (owed < F.col("size")), F.array(F.struct(F.lit(1.0).alias("finish"), owed.alias("size")), F.struct((end / F.col("target")).alias("finish"), (F.col("size") - owed).alias("size"))))
    queued = queued.withColumn("part", F.explode(F.coalesce(parts, F.array(F.struct((end / F.col("target")).alias("finish"), F.col("size").alias("size"))))))
    queued = queued.select("row", "part.size", "budget", "rank", "round", "key", "doc_id", "part.finish")

    # The global order, in range partitions; each one's tokens before it, then a running total in it.
    order = ["finish", "rank", "round", "key", "doc_id", "row"]
    served = cut(queued.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "queue")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = served.groupBy("part").agg(F.sum("size").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy(*order))
    served = served.join(cut(parts, "parts"), "part").withColumn("running", running)
    here = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - F.col("running") + F.col("size")))
    taken = served.groupBy("row").agg(F.sum(here).alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle(weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0, docs: str = "documents") -> str:
    """DuckDB SQL for :func:`fair_queue` with a share of 1, for tables without null or repeated ids."""
    picks = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(weights))
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS key
      FROM {docs}),
    sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM sized GROUP BY source),
    weighed AS (
      SELECT *, CASE (rank - 1) % {len(weights)} {picks} END AS weight, source_size * {float(cap)}::DOUBLE AS most,
             sum(source_size) OVER () AS budget FROM sources),
    levels AS (
      SELECT *, (budget - coalesce(sum(most) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
      FROM weighed WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    found AS (SELECT level FROM levels WHERE level <= most / weight ORDER BY most / weight, rank LIMIT 1),
    targets AS (SELECT l.*, least(l.most, l.weight * f.level) AS target FROM levels l, found f),
    queued AS (
      SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target, t.rank, t.budget,
             sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    rounds AS (
      SELECT q.*, r.round, (upto + r.round * source_size)::DOUBLE / target AS finish,
             floor(target)::BIGINT - (upto + r.round * source_size) + size AS owed
      FROM queued q, range({cap}) r(round) WHERE size > 0 AND target > 0),
    served AS (
      SELECT * FROM rounds WHERE owed <= 0 OR owed >= size
      UNION ALL SELECT * REPLACE (owed AS size, 1.0::DOUBLE AS finish) FROM rounds WHERE owed > 0 AND owed < size
      UNION ALL SELECT * REPLACE (size - owed AS size) FROM rounds WHERE owed > 0 AND owed < size),
    totals AS (
      SELECT doc_id, greatest(0, least(size, budget - sum(size) OVER (
        ORDER BY finish, rank, round, key, doc_id ROWS UNBOUNDED PRECEDING) + size)) AS here FROM served),
    taken AS (SELECT doc_id, sum(here)::BIGINT AS taken FROM totals GROUP BY doc_id)
    SELECT q.doc_id, q.size, q.source_size, q.target::DOUBLE AS target, coalesce(t.taken, 0)::BIGINT AS taken
    FROM queued q LEFT JOIN taken t USING (doc_id)"""
