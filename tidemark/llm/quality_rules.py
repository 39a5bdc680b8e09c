"""Quality rules with risk-controlled thresholds.

Each rule has a statistic and a list of cutoffs, from lenient to strict. Labelled documents that pass the base rules
are split in two by a hash of their id. On the fit half each cutoff gets its tail, the part of the good documents beyond
it; a cutoff with none gets minus the number of stricter cutoffs that have none either. A threshold is one number c for
all rules: a document is rejected if it is beyond a cutoff whose tail is c or less. So thresholds are nested, those below 0
keep a distance from all good documents of the fit half, and there are no more of them than cutoffs.

The holdout half decides. Thresholds are tried from the most lenient to the strictest; each tests the hypothesis that
it rejects more than ``alpha`` of a stratum's good documents, by the exact binomial tail of what it rejected of them.
Testing stops at the first that is not certified, so a fixed sequence spends one error budget, and ``delta`` is divided
by the number of strata (Bonferroni). Of the certified thresholds the one that rejects most bad documents is taken, the most
lenient of equals; none, if it rejects bad documents less than ``lift`` times as often as good ones. With probability
1 - delta no stratum loses more than ``alpha`` of the good documents that pass the base rules. What the base rules reject
is fixed and not part of this risk; :func:`certified` reports it beside the risk.

Strata are languages. One with fewer good holdout labels than a threshold needs that rejects none of them,
log(delta / strata) / log(1 - alpha), is pooled with the others like it and with the next larger ones until the pool has
as many, and documents of strata without labels with them; the guarantee holds for the pool as a whole. If all labels
together are too few there is no threshold, and only base rules hold.

Only counts by stratum and cutoff are gathered. Base statistics cover whole texts; a null text has no words and fails.
Labels with nulls teach nothing; of several labels of one document the least counts. A null stratum is one of its own.
Repeated rows give a row each. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut
from tidemark.llm import words as W

ALPHA, DELTA, LIFT = 0.02, 0.05, 3.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words"]
STATISTICS = "row long, doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
# Characters by class: the base statistic's symbols, other ASCII marks, capitals, digits.
CLASSES = {"n_symbols": b"#*$%&|<>", "n_marks": b"!\"'()+,-./:;=?@[\\]^_`{}~", "n_capitals": bytes(range(65, 91)), "n_digits": bytes(range(48, 58))}
# Each rule: numerator, denominator, and cutoffs from lenient to strict; a statistic above its cutoff rejects, "-" means below it.
RULES = {
    "symbols": ("n_symbols / word_chars", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]),
    "marks": ("n_marks / word_chars", [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06]),
    "capitals": ("n_capitals / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "digits": ("n_digits / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / n_words", [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0]),
    "short_words": ("-word_chars / n_words", [-1.2, -1.5, -2.0, -2.5, -3.0, -3.5]),
}
POOL = "*"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = W.space_table()
    members = {}
    for name, characters in CLASSES.items():
        members[name] = np.zeros(256, bool)
        members[name][np.frombuffer(characters, np.uint8)] = True
    point = np.ones(256, bool)  # bytes that begin a code point
    point[0x80:0xC0] = False
    per_row = lambda flags, at: np.diff(np.append(0, np.cumsum(flags))[at])
    for b in batches:
        for block in W.blocks(b.column("text"), table):
            lines, dups = [], []
            for r in range(block.rows):
                mine = [x for x in block.text(r).split(b"\n") if x.strip()]
                lines.append(len(mine))
                dups.append(len(mine) - len(set(mine)))
            part = b.slice(block.lo, block.rows)
            found = {"n_words": block.counts(), "word_chars": per_row(table[block.data] & point[block.data], block.offsets)}
            found |= {name: per_row(is_in[block.data], block.offsets) for name, is_in in members.items()}
            found |= {"n_lines": lines, "n_dup_lines": dups, "n_repeat_words": per_row(_repeated(block, 3), block.first)}
            columns = [*(part.column(c) for c in ("row", "doc_id", "stratum")), *(pa.array(found[c], pa.int64()) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "stratum", *COUNTS])


def _repeated(block: W.Block, n: int) -> np.ndarray:
    """Of each word, whether it is in an n-word window that its row has twice or more."""
    words = int(block.first[-1])
    out = np.zeros(words, bool)
    at = W.inside_row(block, n)
    if not len(at):
        return out
    bits = max(1, int(block.rows).bit_length())
    key = (block.row_of_word()[at].astype(W.U) << W.U(64 - bits)) | (W.rolling(block.hashes(), n)[at] >> W.U(bits))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.append(same, False) | np.append(False, same)]]
    for i in range(n):
        out[twice + i] = True
    return out


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Return the statistics of each document, with its row number and stratum."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text")
    return rows.mapInArrow(_statistics, STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(rule: str) -> Column:
    over, under = RULES[rule][0].lstrip("-").split(" / ")
    value = F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))
    return -value if RULES[rule][0].startswith("-") else value


def _passed() -> Column:
    """Of each rule, how many of its cutoffs the document is beyond; they are nested."""
    count = lambda value, cutoffs: F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: value > c))
    return F.array(*[count(_value(rule), cutoffs) for rule, (_, cutoffs) in RULES.items()])


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("-"))


def _tails_here() -> Column:
    """Of each rule, the tail of the strictest cutoff that the document is beyond; 1 if there is none."""
    return F.zip_with("tails", "passed", lambda t, k: F.element_at(t, k + 1))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), summed in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(level: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, error: float, lift: float) -> float | None:
    """The certified threshold that rejects most bad documents; none if there is none worth having.

    ``good`` and ``bad`` count the holdout documents that have each ``level``, the least of their tails.
    """
    n_good, n_bad, best, most = int(good.sum()), int(bad.sum()), None, 0
    for c in sorted({float(x) for x in level if x <= alpha}):
        k_good, k_bad = int(good[level <= c].sum()), int(bad[level <= c].sum())
        if not n_good or k_good >= alpha * n_good or binomial_tail(k_good, n_good, alpha) > error:
            break
        if k_bad > most and k_bad * n_good >= lift * k_good * n_bad:
            best, most = c, k_bad
    return best


def certified(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, lift: float = LIFT) -> DataFrame:
    """Return (stratum, threshold, tails, n_good, k_good, n_bad, k_bad, n_good_base): what holds in each stratum, by holdout counts.

    ``stratum`` has the mark "=" before its name, "-" is null and "*" the pool; ``n_good_base`` are the good holdout documents
    that the base rules reject.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = stats.join(labels, "doc_id").select(_stratum().alias("stratum"), (F.col("quality") > 0).alias("good"), base_failed().alias("failed"), _passed().alias("passed"), (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("fits"))
    held = cut(held, "labelled")
    sizes = cut(held.groupBy("stratum").agg(F.count_if(F.expr("good AND NOT failed AND NOT fits")).alias("n")), "strata")
    strata = max(1, sizes.count())
    least = math.ceil(math.log(delta / strata) / math.log1p(-alpha))
    before = Window.orderBy("n", "stratum").rowsBetween(Window.unboundedPreceding, -1)  # over a row a stratum
    small = (F.col("n") < least) | (F.sum("n").over(before) < least)
    names = sizes.select("stratum", F.when(F.coalesce(small, F.lit(False)), POOL).otherwise(F.col("stratum")).alias("group"))
    held = cut(held.join(names, "stratum").drop("stratum"), "grouped")
    groups = max(1, held.select("group").distinct().count())
    fitted = held.where("fits AND good AND NOT failed").select("group", F.posexplode("passed").alias("rule", "k")).groupBy("group", "rule", "k").agg(F.count(F.lit(1)).alias("n"))

    def tails(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, (_, cutoffs) in enumerate(RULES.values()):
            mine = group[group["rule"] == i]
            count = np.bincount(mine["k"], mine["n"], len(cutoffs) + 1)
            tail = count[::-1].cumsum()[::-1] / count.sum()
            some = np.count_nonzero(tail)
            out.append([float(x) for x in np.where(tail > 0, tail, some - np.arange(len(tail)))])
        return pd.DataFrame({"group": group["group"].iloc[:1], "tails": [out]})

    tables = cut(fitted.groupBy("group").applyInPandas(tails, "group string, tails array<array<double>>"), "tails")
    levels = held.where("NOT fits").join(tables, "group").withColumn("level", F.array_min(_tails_here()))
    counts = levels.groupBy("group", "failed", "level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        base, group = group[group["failed"]], group[~group["failed"]]
        level, good, bad = (group[c].to_numpy() for c in ("level", "good", "bad"))
        c = choose(level, good, bad, alpha, delta / groups, lift)
        hit = level <= (-np.inf if c is None else c)
        row = {"threshold": c, "n_good": good.sum(), "k_good": good[hit].sum(), "n_bad": bad.sum(), "k_bad": bad[hit].sum(), "n_good_base": base["good"].sum()}
        return pd.DataFrame([{"group": (base if group.empty else group)["group"].iloc[0]} | row])

    picked = counts.groupBy("group").applyInPandas(pick, "group string, threshold double, n_good long, k_good long, n_bad long, k_bad long, n_good_base long")
    return picked.join(tables, "group").withColumnRenamed("group", "stratum")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk: float) -> DataFrame:
    """Return the statistics, base_failed, the rules that reject, and kept, of each document."""
    stats = cut(statistics(docs, stratum), "statistics")
    found = cut(certified(stats, labels, **risk), "thresholds").select(F.col("stratum").alias("__stratum"), "threshold", "tails")
    pool = found.where(F.col("__stratum") == POOL).collect()  # one row at most, a number for each cutoff
    threshold, tails = (pool[0]["threshold"], pool[0]["tails"]) if pool else (None, [])
    rows = stats.join(found, _stratum() == F.col("__stratum"), "left")
    own = F.col("__stratum").isNotNull()
    pooled = F.array(*[F.array(*[F.lit(t) for t in each]) for each in tails]).cast("array<array<double>>")
    rows = rows.withColumns({"threshold": F.when(own, F.col("threshold")).otherwise(F.lit(threshold).cast("double")), "tails": F.when(own, F.col("tails")).otherwise(pooled if pool else None), "passed": _passed()})
    beyond = F.transform(_tails_here(), lambda t: F.coalesce(t <= F.col("threshold"), F.lit(False)))
    names = F.array(*[F.lit(r) for r in RULES])
    by = F.filter(F.zip_with(names, F.coalesce(beyond, F.array()), lambda r, hit: F.when(hit, r)), lambda r: r.isNotNull())
    rows = rows.withColumns({"base_failed": base_failed(), "rejected_by": by})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("__stratum", "threshold", "tails", "passed")


def oracle(alpha: float = ALPHA, delta: float = DELTA, lift: float = LIFT) -> str:
    """DuckDB SQL for the query's columns of :func:`judge`, for tables whose ids differ."""
    quoted = lambda characters: "'" + characters.decode().replace("'", "''") + "'"
    classes = ", ".join(f"length(text) - length(translate(text, {quoted(c)}, '')) AS {name}" for name, c in CLASSES.items())
    counted = []
    for value, cutoffs in RULES.values():
        over, under = value.lstrip("-").split(" / ")
        ratio = f"{'-' * value.startswith('-')}coalesce({over}::DOUBLE / nullif({under}, 0), 0)"
        counted.append(f"len(list_filter([{', '.join(f'{c}::DOUBLE' for c in cutoffs)}], lambda c: {ratio} > c))")
    return rf"""
    WITH cells AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM cells)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(3)) AS k FROM twice) GROUP BY doc_id),
    lines AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM cells) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    stats AS (
      SELECT c.doc_id, coalesce('=' || lang, '-') AS stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars, {classes},
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM cells c LEFT JOIN lines l ON l.doc_id = c.doc_id LEFT JOIN repeats r ON r.doc_id = c.doc_id),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{', '.join(counted)}] AS passed FROM stats),
    taught AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    held AS (SELECT j.*, good, substr(md5(j.doc_id::VARCHAR), 1, 1) < '8' AS fits FROM judged j JOIN taught t ON t.doc_id = j.doc_id),
    sizes AS (SELECT stratum, count(*) FILTER (good AND NOT base_failed AND NOT fits) AS n, count(*) OVER () AS strata FROM held GROUP BY stratum),
    ranked AS (SELECT *, ceil(ln({delta}::DOUBLE / strata) / ln(1 - {alpha}::DOUBLE)) AS least, sum(n) OVER (ORDER BY n, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sizes),
    large AS (SELECT stratum FROM ranked WHERE n >= least AND coalesce(before >= least, true)),
    grouped AS (SELECT h.*, coalesce(l.stratum, '{POOL}') AS grp FROM held h LEFT JOIN large l ON l.stratum = h.stratum),
    groups AS (SELECT count(DISTINCT grp) AS n FROM grouped),
    fitted AS (SELECT grp, unnest(passed) AS k, generate_subscripts(passed, 1) AS rule FROM grouped WHERE fits AND good AND NOT base_failed),
    parts AS (
      SELECT f.grp, f.rule, r.k, count(*) FILTER (f.k >= r.k)::DOUBLE / count(*) AS part FROM fitted f, range({1 + max(len(c) for _, c in RULES.values())}) r(k) GROUP BY ALL),
    tails AS (SELECT grp, rule, k, CASE WHEN part > 0 THEN part ELSE min(k) FILTER (part = 0) OVER (PARTITION BY grp, rule) - k END::DOUBLE AS tail FROM parts),
    asked AS (SELECT doc_id, grp, good, unnest(passed) AS k, generate_subscripts(passed, 1) AS rule FROM grouped WHERE NOT fits AND NOT base_failed),
    levels AS (SELECT a.doc_id, any_value(a.grp) AS grp, any_value(a.good) AS good, min(t.tail) AS level FROM asked a JOIN tails t ON t.grp = a.grp AND t.rule = a.rule AND t.k = a.k GROUP BY a.doc_id),
    tried AS (SELECT DISTINCT grp, level AS c FROM levels WHERE level <= {alpha}),
    counts AS (
      SELECT t.grp, t.c, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND level <= c) AS k_good, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (NOT good AND level <= c) AS k_bad
      FROM tried t JOIN levels l ON l.grp = t.grp GROUP BY ALL),
    tested AS (
      SELECT *, n_good > 0 AND k_good < {alpha} * n_good AND list_sum(list_transform(range(k_good + 1), lambda i:
        exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({alpha}::DOUBLE) + (n_good - i) * ln(1 - {alpha}::DOUBLE)))) <= {delta}::DOUBLE / (SELECT n FROM groups) AS ok FROM counts),
    sure AS (SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY grp ORDER BY c) AS all_ok FROM tested) WHERE all_ok AND k_bad > 0 AND k_bad * n_good >= {lift} * k_good * n_bad),
    chosen AS (SELECT grp, c FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k_bad DESC, c) AS place FROM sure) WHERE place = 1),
    each AS (SELECT j.doc_id, coalesce(l.stratum, '{POOL}') AS grp, unnest(passed) AS k, generate_subscripts(passed, 1) AS rule FROM judged j LEFT JOIN large l ON l.stratum = j.stratum),
    rejected AS (SELECT DISTINCT e.doc_id FROM each e JOIN tails t ON t.grp = e.grp AND t.rule = e.rule AND t.k = e.k JOIN chosen c ON c.grp = e.grp WHERE t.tail <= c.c)
    SELECT j.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
           base_failed, NOT base_failed AND r.doc_id IS NULL AS kept
    FROM judged j LEFT JOIN rejected r ON r.doc_id = j.doc_id"""
