"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base kinds are found by their patterns. The method adds candidates of the kind ``opaque``: long runs of token
characters that mix digits with letters of both cases and overlap no base span. All candidate values are hashed and
aggregated over the whole corpus by distinct repositories and distinct owners. A value with ``shared_owners`` owners or
``shared_repos`` repositories or more is a widely copied example; a value of fewer whose characters have an entropy of
``entropy`` bits or more looks live. Opaque spans are kept where they look live; base spans always stay.

Places are code points. A pattern's matches are placed by adding up the lengths of matches and of the text between
them. A null text is empty; a null owner or repository counts for none. Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut

# The base kinds, in the order in which ties are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = [*PATTERNS, "opaque"]
MATCHES = "array<struct<kind:string,gap:int,length:int,secret:string>>"
# Faster ways to start the same match: only where its first character can stand.
STARTS = {"assign": r"(?=[PSTApsta])"}


def _matches(kind: str, pattern: str) -> Column:
    """(kind, length of the text before it, its own length, secret) of each match, in order; null if there is none."""
    p = F.lit(STARTS.get(kind, "") + pattern)
    text = F.col("text")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    secret = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else whole
    gaps = F.split(text, STARTS.get(kind, "") + pattern, -1)
    rows = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), secret.alias("secret")), lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("length"), x["secret"].alias("secret"),
    ))
    return F.when(text.rlike(STARTS.get(kind, "") + pattern), rows)


def _long_enough() -> Column:
    least = F.when(F.col("kind") == "assign", 6).when(F.col("kind") == "access", 20).otherwise(24)
    return F.length("secret") >= least


def _placed(found: DataFrame) -> DataFrame:
    rows = found.select("row", "repository", "owner", F.posexplode("m").alias("at", "m")).select("row", "repository", "owner", "at", "m.*")
    upto = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("at"))
    rows = rows.withColumns({"end": upto.cast("long"), "start": (upto - F.col("length")).cast("long")})
    mixed = F.col("secret").rlike("[0-9]") & F.col("secret").rlike("[a-z]") & F.col("secret").rlike("[A-Z]")
    rows = rows.where(_long_enough() & ((F.col("kind") != "opaque") | mixed))
    return rows.select("row", "repository", "owner", "kind", "start", "end", F.xxhash64("secret").alias("value"), _entropy("secret").alias("entropy"))


def _entropy(text: str) -> Column:
    """Bits a character, by the text's own frequencies of characters."""
    chars, n = F.filter(F.split(text, ""), lambda x: x != ""), F.length(text)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - part(c) * F.log2(part(c)))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", shared_owners: int = 3, shared_repos: int = 50, entropy: float = 3.0) -> DataFrame:
    """Return (doc_id, spans) of each document; spans: (start, kind, end, class, is_base) in the order of start, then kind.

    ``class`` is shared, live or weak. Ownership is counted over all of ``docs``.
    """
    rows = docs.select("doc_id", "text", F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # One pass over the texts: every document's row number, and its matches if it has any.
    kinds = {**PATTERNS, "opaque": OPAQUE}
    matches = F.concat(*[F.coalesce(_matches(k, p), F.array().cast(MATCHES)) for k, p in kinds.items()])
    found = cut(rows.select("row", "doc_id", "repository", "owner", matches.alias("m")), "matches")
    hits = cut(_placed(found), "candidates")
    spread = hits.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repos"))
    shared = (F.col("owners") >= shared_owners) | (F.col("repos") >= shared_repos)
    classes = cut(spread.select("value", shared.alias("shared")), "classes")
    hits = hits.join(classes, "value").withColumn("class", F.when(F.col("shared"), "shared").when(F.col("entropy") >= entropy, "live").otherwise("weak"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("rank"), "kind", "end", "class", (F.col("kind") != "opaque").alias("is_base"))
    per_row = hits.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    base = F.filter("spans", lambda s: s["is_base"])
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("spans", lambda s: s["is_base"] | ((s["class"] == "live") & apart(s)))
    return found.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce(added, F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans of :func:`scan`'s result."""
    base = F.filter("spans", lambda s: s["is_base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = {f"n_{k}": count(of_kind(k)) for k in PATTERNS}
    return scanned.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count(lambda s: s["class"] == "live").alias("n_live"), count(lambda s: s["class"] == "shared").alias("n_shared"),
    )


def oracle(shared_owners: int = 3, shared_repos: int = 50, entropy: float = 3.0) -> str:
    """DuckDB SQL for :func:`digest`, for tables whose ids differ.

    Its patterns have no look-around: an opaque candidate is a whole run of token characters that is long and has a digit.
    """
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    kinds = {**PATTERNS, "opaque": "[A-Za-z0-9+/_-]+={0,2}"}
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, {quoted(p)}) AS whole, regexp_extract_all(text, {quoted(p)}, {2 if kind == 'assign' else 0}) AS secret, "
        f"string_split_regex(text, {quoted(p)}) AS gaps FROM texts" for rank, (kind, p) in enumerate(kinds.items())
    )
    least = "CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 24 END"
    joined = "string_agg(kind || ':' || start::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY start, rank)"
    return rf"""
    WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    raw AS (SELECT doc_id, source, kind, rank, unnest(whole) AS whole, unnest(secret) AS secret, unnest(gaps[1 : len(whole)]) AS gap, generate_subscripts(whole, 1) AS nth FROM found WHERE len(whole) > 0),
    placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT AS stop FROM raw),
    hits AS (
      SELECT doc_id, source, kind, rank, secret, stop - length(whole) AS start, stop FROM placed
      WHERE length(secret) >= {least} AND (kind <> 'opaque' OR length(rtrim(whole, '=')) >= 24 AND regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[a-z]') AND regexp_matches(whole, '[A-Z]'))),
    owners AS (SELECT secret, count(DISTINCT source) >= {shared_owners} OR count(DISTINCT doc_id) >= {shared_repos} AS shared FROM hits GROUP BY secret),
    letters AS (SELECT secret, c, count(*)::DOUBLE / length(secret) AS part FROM (SELECT secret, unnest(string_split(secret, '')) AS c FROM owners) GROUP BY secret, c),
    bits AS (SELECT secret, -sum(part * log2(part)) AS entropy FROM letters GROUP BY secret),
    classed AS (
      SELECT h.*, CASE WHEN shared THEN 'shared' WHEN entropy >= {entropy} THEN 'live' ELSE 'weak' END AS class
      FROM hits h JOIN owners o ON o.secret = h.secret JOIN bits b ON b.secret = h.secret),
    kept AS (
      SELECT * FROM classed c WHERE kind <> 'opaque' OR class = 'live' AND NOT EXISTS (
        SELECT 1 FROM classed b WHERE b.doc_id = c.doc_id AND b.kind <> 'opaque' AND b.start < c.stop AND c.start < b.stop)),
    totals AS (
      SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PATTERNS)}, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'shared') AS n_shared,
             {joined} FILTER (kind <> 'opaque') AS base, {joined} AS spans FROM kept GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared
    FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id"""
