"""Near-duplicate classes with ProbMinHash.

A document is its five-word shingles, each weighted 1 + ln(times it is there). Every shingle is a Poisson process whose
rate is its weight: its arrivals each hit one of ``REGISTERS`` at random, and a register keeps the shingle that hit it
first. A shingle stops as soon as its next arrival is later than every register's first, so long documents cost about
one arrival a shingle. The chance that two documents agree in a register is their probability Jaccard similarity.

Registers are banded: texts that agree in a whole band of ``ROWS`` registers meet in a bucket. A pair in a bucket is
linked when the exact Jaccard similarity of the two shingle sets is ``threshold`` or more, computed from the texts.
At a similarity of 0.8 a pair meets in one of 32 bands of 6 with a probability of 0.99994.

Equal texts are one node, told apart by a 64-bit hash, so copies are never paired. Buckets are worked off without
pairing all their members. First every bucket compares its members with one of them, chosen at random. Members of one
component need no more comparing; nodes of buckets that still hold several components go to an exact set join by
prefix filtering. Shingles are ordered by rarity there, and two sets as similar as asked must share one of their
rarest 1 - threshold parts. A large group of loose copies has its many own shingles in these parts and so few pairs,
and no link that could join two components is left out. Rarity is read from a sketch whose counters follow the number
of sets, within ``SLOTS``: any order that all agree on is right, so the sketch's errors cost time only. Classes are the
connected components.

Texts of fewer than five words have one shingle, the whole text. Null texts and texts without words are in a class of
their own. Repeated rows are in one class. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.graph import components
from tidemark.functions.scratch import cut, release
from tidemark.llm import words as W

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
SLOTS = (1 << 17, 1 << 21)  # counters of the rarity sketch, least and most; 64 a set between
BITS = 52  # of a shingle's hash; the others number the rows of a block
MASKS = 8
MASK_NAMES = [f"m{i}" for i in range(MASKS)]


def _blocks(column: pa.Array, table: np.ndarray) -> Iterator[W.Block]:
    return W.blocks(column, table, rows=1 << (64 - BITS))


def shingle_sets(block: W.Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of the distinct shingles of each row, by row; a short row is one shingle.

    A shingle is ``BITS`` bits of its hash, so that it sorts in one word with its row in the block.
    """
    h, counts = block.hashes(), block.counts()
    at = W.inside_row(block, n)
    row, s = block.row_of_word()[at], W.rolling(h, n)[at] if len(at) else np.zeros(0, W.U)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [W.rolling(h[block.first[r] : block.first[r + 1]], int(counts[r]))[0] for r in short]
        row, s = np.append(row, short), np.append(s, np.array(whole, W.U))
    key = np.sort((row.astype(W.U) << W.U(BITS)) | (s >> W.U(64 - BITS)))
    if not len(key):
        return np.zeros(0, int), key, np.zeros(0, int)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[new] >> W.U(BITS)).astype(int), key[new] & W.U((1 << BITS) - 1), np.diff(np.append(new, len(key)))


def signatures(row: np.ndarray, shingle: np.ndarray, times: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """The registers of each row; those of rows without shingles are 0."""
    first = np.full(rows * m, np.inf)
    kept = np.zeros(rows * m, W.U)
    seed = W.mix(shingle + W.U(1))
    alone = np.bincount(row, minlength=rows)[row] == 1
    kept.reshape(rows, m)[row[alone]] = seed[alone][:, None]
    row, seed, weight = row[~alone], seed[~alone], 1.0 + np.log(times[~alone])
    clock, j = np.zeros(len(row)), 0
    with np.errstate(over="ignore"):
        while len(row):
            bits = W.mix(seed + W.U(j * 0x9E3779B97F4A7C15 % (1 << 64)))
            clock = clock - np.log(((bits >> W.U(12)).astype(float) + 0.5) * 2.0**-52) / weight
            at = row * m + (((bits & W.U(0xFFF)) * W.U(m)) >> W.U(12)).astype(int)
            np.minimum.at(first, at, clock)
            won = first[at] == clock
            kept[at[won]] = seed[won]
            j += 1
            if j < 8 or j % 8 == 0:
                active = clock < first.reshape(rows, m).max(axis=1)[row]
                row, seed, weight, clock = row[active], seed[active], weight[active], clock[active]
    return kept.reshape(rows, m)


def band_hashes(kept: np.ndarray) -> np.ndarray:
    """One hash for each band of each row."""
    out = np.zeros((len(kept), BANDS), W.U)
    for i in range(ROWS):
        out = out * W.U(0xD1342543DE82EF95) + kept[:, i::ROWS]
    return W.mix(out + np.arange(BANDS, dtype=W.U) * W.U(0x9E3779B97F4A7C15))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = W.space_table()
    for b in batches:
        for block in _blocks(b.column("text"), table):
            rows = block.rows
            sketch = band_hashes(signatures(*shingle_sets(block, SHINGLE), rows))
            some = block.counts() > 0
            part = b.slice(block.lo, rows)
            flat = pa.array(W.signed(sketch.ravel()), pa.int64())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), flat)
            node = pa.compute.if_else(pa.array(some), part.column("node"), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), node, bands], names=["row", "doc_id", "node", "bands"])


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.space_table()
        for b in (part for whole in batches for part in W.slices(whole, ["text_a", "text_b"])):
            sets: list[list[np.ndarray]] = []
            for name in ("text_a", "text_b"):
                mine: list[np.ndarray] = []
                for block in _blocks(b.column(name), table):
                    row, shingle, _ = shingle_sets(block, SHINGLE)
                    mine += np.split(shingle, np.searchsorted(row, np.arange(1, block.rows)))
                sets.append(mine)
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) > 0:
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = common >= threshold * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_similar(threshold), "a long, b long")


def _split_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, node, label, is_main) of the buckets that hold several components; the main one has most nodes."""
    labels = components(links)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    labels = cut(labels.join(sizes, "label"), "labels")
    rows = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    rows = cut(rows, "labelled")
    several = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("size", "label")).alias("main")).where("lo < hi")
    several = cut(several.select("bucket", F.col("main.label").alias("main")), "several")
    return cut(rows.join(several, "bucket").select("bucket", "node", "label", (F.col("label") == F.col("main")).alias("is_main")), "open")


def _rarity(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(slots, np.int64), W.space_table()
        for b in batches:
            for block in _blocks(b.column("text"), table):
                total += np.bincount((shingle_sets(block, SHINGLE)[1] % W.U(slots)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(total)
        yield W.batch({"slot": (some.astype(np.int32), pa.int32()), "c": (total[some], pa.int64())})

    return run


def _prefixes(sent, threshold: float):
    """(token, node, label, only_main, n, place, masks) of each set's rarest shingles, one of which a similar set must share.

    The masks are the set's parities over 64 * MASKS hash slots: two sets differ in as many shingles at least as in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = W.space_table(), sent.value
        for b in batches:
            for block in _blocks(b.column("text"), table):
                row, shingle, _ = shingle_sets(block, SHINGLE)
                order = np.lexsort((shingle, counts[(shingle % W.U(len(counts))).astype(np.int64)], row))
                shingle = shingle[order]
                n = np.bincount(row, minlength=block.rows)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = place < (n - np.ceil(threshold * n - 1e-9).astype(int) + 1)[row]
                bit = (W.mix(shingle) % W.U(64 * MASKS)).astype(np.int64)
                parity = np.bincount(row * 64 * MASKS + bit, minlength=block.rows * 64 * MASKS).astype(W.U).reshape(block.rows, MASKS, 64) & W.U(1)
                masks = (parity << np.arange(64, dtype=W.U)).sum(axis=2, dtype=W.U)
                part = b.select(["node", "label", "only_main"]).slice(block.lo, block.rows).take(pa.array(row[keep]))
                columns = [pa.array(shingle[keep].astype(np.int64)), *(part.column(c) for c in ("node", "label", "only_main")), pa.array(n[row[keep]], pa.int32()), pa.array(place[keep], pa.int32())]
                columns += [pa.array(W.signed(masks[:, i][row[keep]]), pa.int64()) for i in range(MASKS)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "label", "only_main", "n", "place", *MASK_NAMES])

    return run


def _prefix_pairs(open_buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that share a prefix shingle and may be similar enough by size, place and masks."""
    nodes = open_buckets.groupBy("node", "label").agg(F.min("is_main").alias("only_main"))
    sets = cut(texts.join(nodes, "node"), "sets")
    slots = min(SLOTS[1], max(SLOTS[0], 1 << (64 * sets.count()).bit_length()))
    rarity = sets.select("text").mapInArrow(_rarity(slots), "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # a row a counter at most
    counts = np.zeros(slots, np.int64)
    counts[rarity["slot"].to_numpy()] = rarity["c"].to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    tokens = cut(sets.mapInArrow(_prefixes(sent, threshold), "token long, node long, label long, only_main boolean, n int, place int, " + ", ".join(f"{m} long" for m in MASK_NAMES)), "prefixes")
    # Of two nodes in different components of a bucket one is not in the bucket's main component.
    other = tokens.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "place", *MASK_NAMES)])
    both = tokens.where("NOT only_main").join(other, "token").where("label <> label2")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9)
    may = (F.least("n", "n2") >= threshold * F.greatest("n", "n2") - 1e-9) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= need)
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}2"))) for m in MASK_NAMES), F.lit(0))
    may &= differ <= (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("n2")) + 1e-9
    return both.where(may).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """Return (row, doc_id, class_id, is_first) of each document.

    ``class_id`` is the least doc_id of its class, ``is_first`` marks one row of each class, and ``row`` is the
    column of that name, or numbers the rows of ``docs`` as ``monotonically_increasing_id`` does. Such numbers hold for
    one scan only; a caller who joins on them has to write them first and name their column.
    """
    docs = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("node"), "text")
    sketched = cut(docs.mapInArrow(_sketch, "row long, doc_id long, node long, bands array<long>"), "sketches")
    banded = sketched.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    members = cut(banded.join(cut(shared, "buckets"), "bucket", "left_semi").distinct(), "members")
    nodes = cut(members.select("node").distinct(), "nodes")
    texts = docs.select("node", "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = cut(texts, "texts")

    # One member of each bucket against the others, then an exact join of what is still apart.
    centre = F.min(F.struct(F.xxhash64("node").alias("draw"), "node"))
    centres = cut(members.groupBy("bucket").agg(centre.alias("c")).select("bucket", F.col("c.node").alias("centre")), "centres")
    met = members.join(centres, "bucket").where("node <> centre")
    pairs = cut(met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    links = cut(_verified(pairs, texts, threshold), "links")
    open_buckets = _split_buckets(members, links)
    more = cut(_prefix_pairs(open_buckets, texts, threshold).join(pairs, ["a", "b"], "left_anti"), "more_pairs")
    all_links = cut(links.unionByName(_verified(more, texts, threshold)), "links")
    release(members, nodes, texts, centres, pairs, links, open_buckets, more)

    # A document without words is a class of its own, under its row's number.
    key = F.coalesce(F.col("label"), F.col("node"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    labels = components(all_links)
    rows = sketched.select("row", "doc_id", "node").join(labels, "node", "left").select("row", "doc_id", key.alias("node"))
    lone = sketched.where("node IS NULL").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"))
    rows = cut(rows.where("node IS NOT NULL"), "rows")
    classes = rows.groupBy("node").agg(F.min(order).alias("f"))
    classes = cut(classes.select("node", F.col("f.doc_id").alias("class_id"), F.col("f.row").alias("first_row")), "classes")
    release(all_links, labels)
    return rows.join(classes, "node").select("row", "doc_id", "class_id", (F.col("row") == F.col("first_row")).alias("is_first")).unionByName(lone)


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for (doc_id, class_id) of :func:`near_duplicates`, for tables whose ids differ: all pairs by shared shingles."""
    return rf"""
    WITH RECURSIVE cells AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
    shingles AS (
      SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) AS s
      FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - {SHINGLE - 1}) + 1)) AS i FROM cells WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    pairs AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE c.n >= {threshold} * (x.n + y.n - c.n)),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reached AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT l.b, r.label FROM reached r JOIN links l ON l.a = r.node WHERE r.label < l.b)
    SELECT node AS doc_id, min(label) AS class_id FROM reached GROUP BY node"""
