"""Line dedup by spread over distinct sites.

A line, without white space at its ends, is boilerplate if it is on ``min_sites`` distinct sites or more. Lines on one
site only are dropped by a plain aggregation. Of the others each gets a HyperLogLog sketch of its sites; sketches
merge by aggregation, on the map side first, so a line on a third of all pages is no large group. Where a sketch's
estimate is within ``margin`` standard errors of the threshold, the sites are counted exactly. Boilerplate lines are
then taken out of every document, by one join on the document's key that is the same at every size: the smaller side holds
hashes of lines only, and what it weighs grows with the corpus, so it is not broadcast.

Blank lines are never boilerplate. A null source is one unknown site. A null text stays null. Repeated rows and rows
that share an id are each cleaned by their own text. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut

BLANK = " \t\r\v\f"
MIN_SITES = 10


def _key(line):
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 10, margin: float = 5.0) -> DataFrame:
    """Return the (line) hashes on ``min_sites`` sites or more of (line, site) rows."""
    several = lines.groupBy("line").agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo < hi").select("line")
    several = lines.join(cut(several, "several"), "line", "left_semi")
    spread = several.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    spread = cut(spread, "spread")
    slack = margin * 1.04 / (1 << lg_k) ** 0.5 * min_sites + 1
    sure = spread.where(F.col("sites") > min_sites + slack).select("line")
    near = spread.where(F.col("sites").between(min_sites - slack, min_sites + slack)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Return ``docs`` with ``text`` cleaned, and n_lines and n_removed added (they replace columns of these names)."""
    if min_sites < 2:
        raise ValueError("min_sites must be 2 at least")
    split = F.split("text", "\n")
    keys = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(site).alias("site"), F.explode(F.array_distinct(F.transform(F.filter(split, lambda x: F.btrim(x, F.lit(BLANK)) != ""), _key))).alias("line"))
    keys = cut(keys, "lines")
    found = cut(boilerplate(keys, min_sites), "boilerplate")
    per_doc = keys.select("rid", "line").join(found, "line", "left_semi").groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("line").alias("__gone"))
    rows = docs.withColumn("__rid", F.xxhash64("doc_id", "text")).join(cut(per_doc, "gone").hint("shuffle_hash"), "__rid", "left")
    gone = F.coalesce("__gone", F.array().cast("array<bigint>"))
    kept = F.filter(split, lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~F.array_contains(gone, _key(x)))
    rows = rows.withColumn("__kept", F.when(F.size(gone) > 0, kept))
    lines = F.coalesce(F.size(split), F.lit(0))
    return rows.withColumns({
        "text": F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).cast("long"),
        "n_removed": F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(lines - F.size("__kept")).cast("long"),
    }).drop("__rid", "__gone", "__kept")


def oracle(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for the digest of :func:`remove_boilerplate`, for tables whose ids differ."""
    blank = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
    WITH lines AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
      FROM documents WHERE text IS NOT NULL),
    keyed AS (SELECT *, trim(line, {blank}) AS key FROM lines),
    found AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(source, chr(1))) >= {min_sites}),
    marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN found f USING (key)),
    per_doc AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept
      FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
           sha256(p.kept) AS kept_sha256
    FROM documents d LEFT JOIN per_doc p USING (doc_id)"""
