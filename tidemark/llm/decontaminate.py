"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are its runs of ``window`` consecutive words, or the whole item where it is shorter. A
window is a set of ``shingle``-word shingles; a document holds the window only if it holds all of them, so one shingle
of each window is a necessary prefix token.

1. *Order by rarity.* One pass counts the shingles of all documents that may be in the benchmark, as a filter of bits
   tells; the filter spares rows and decides nothing. A window with a shingle that no document has is dropped.
2. *Prefixes.* Each window's rarest shingle stands for it.
3. *Join.* A second pass finds the places of prefix shingles in documents, with the words around them that a window
   could cover, and these are joined with the windows on the shingle. The place in the window must be inside the words
   before it (positional bound), the window's end inside those after it (length bound), and the words are compared.

Documents are read twice, whatever the benchmark's size, and never shuffled; what is shuffled are places of prefix
shingles with at most 2 * ``window`` words. The filter has 64 bits a shingle and ``FILTER_BITS`` at most, so what is
broadcast is bounded; past that size it only passes more.

Null texts and texts without words have no windows and no hits. Items with a null id mark words but are not listed;
items that share an id count once. Repeated documents give a row each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scratch import cut, release
from tidemark.llm import words as W

WINDOW, SHINGLE = 13, 4
FILTER_BITS = 28  # as a power of two: 32 MB
CHUNK = 16  # a piece of the filter, as a power of two of bits
TEXT, ROW = "__text", "__row"
SPANS = "array<struct<start:bigint,end:bigint>>"
PLACES = pa.list_(pa.struct([("m", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("run", pa.string())]))


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.alnum_table()
        for b in batches:
            for block in W.blocks(b.column("text"), table, lower=True):
                h, counts, item = block.hashes(), block.counts(), b.column("item_id").slice(block.lo, block.rows)
                row_of = block.row_of_word()
                for n in sorted({min(int(c), window) for c in counts} - {0}):
                    m = min(n, shingle)
                    at = W.inside_row(block, n) if n == window else block.first[:-1][counts == n]
                    parts = W.rolling(h, m)[at[:, None] + np.arange(n - m + 1)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (n - m + 1), pa.int32()), pa.array(W.signed(parts.ravel())))
                    columns = {"item": item.take(pa.array(row_of[at])), "n": pa.array(np.full(len(at), n, np.int32)), "m": pa.array(np.full(len(at), m, np.int32))}
                    columns |= {"words": W.runs(block, at, np.full(len(at), n)), "shingles": lists}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


class Filter:
    """A bit for each slot; a shingle that is in has its slot's bit set."""

    def __init__(self, bits: int, held: np.ndarray | None = None) -> None:
        self.bits, self.held = bits, np.zeros(1 << (bits - 3), np.uint8) if held is None else held

    def slot(self, shingle: np.ndarray, m: int) -> np.ndarray:
        return (W.mix(shingle + W.U(m)) >> W.U(64 - self.bits)).astype(np.int64)

    def has(self, shingle: np.ndarray, m: int) -> np.ndarray:
        at = self.slot(shingle, m)
        return ((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _merge_chunks(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, v in held.items():
        yield W.batch({"k": ([k], pa.int32()), "v": ([v.tobytes()], pa.binary())})


def _set_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, held = Filter(bits, np.zeros(0, np.uint8)), {}
        for b in batches:
            m, shingle = b.column("m").to_numpy(), b.column("shingle").to_numpy().view(W.U)
            for size in np.unique(m):
                slots = np.unique(empty.slot(shingle[m == size], int(size)))
                for k in np.unique(slots >> CHUNK):
                    mine = slots[slots >> CHUNK == k] & ((1 << CHUNK) - 1)
                    flags = np.zeros(1 << CHUNK, np.uint8)
                    flags[mine] = 1
                    held[int(k)] = held.get(int(k), 0) | np.packbits(flags, bitorder="little")
        yield from _merge_chunks(held)

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("k").to_pylist(), b.column("v"), strict=True):
            held[k] = held.get(k, 0) | np.frombuffer(v.as_buffer(), np.uint8)
    yield from _merge_chunks(held)


def _sent_filter(spark: SparkSession, shingles: DataFrame):
    """A broadcast of (bits, bytes, sizes of shingles) for the distinct (m, shingle) rows."""
    counts = shingles.groupBy("m").count().collect()  # one row a size of shingle
    bits = min(FILTER_BITS, max(CHUNK, (64 * sum(r["count"] for r in counts)).bit_length()))
    found = shingles.mapInArrow(_set_bits(bits), "k int, v binary").repartition("k").mapInArrow(_unite, "k int, v binary").toArrow()  # 2^FILTER_BITS bits at most
    held = np.zeros((1 << (bits - CHUNK), 1 << (CHUNK - 3)), np.uint8)
    for k, v in zip(found["k"].to_pylist(), found["v"].to_pylist(), strict=True):
        held[k] = np.frombuffer(v, np.uint8)
    return spark.sparkContext.broadcast((bits, held.ravel(), sorted(r["m"] for r in counts)))


def _count(sent):
    """How often each shingle that passes the filter is in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, sizes = sent.value
        wanted, table = Filter(bits, held), W.alnum_table()
        for b in batches:
            for block in W.blocks(b.column("text"), table, lower=True):
                h = block.hashes()
                for m in sizes:
                    s = W.rolling(h, m)[W.inside_row(block, m)]
                    key, c = np.unique(s[wanted.has(s, m)], return_counts=True)
                    yield W.batch({"m": (np.full(len(key), m, np.int32), pa.int32()), "shingle": (W.signed(key), pa.int64()), "c": (c, pa.int64())})

    return run


def _places(sent, keep: list[str], window: int, shingle: int):
    """The places of prefix shingles in each document, with the words that a window there could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, sizes = sent.value
        wanted, table = Filter(bits, held), W.alnum_table()
        for b in batches:
            for block in W.blocks(b.column(TEXT), table, lower=True):
                h, row_of = block.hashes(), block.row_of_word()
                found = []
                for m in sizes:
                    at = W.inside_row(block, m)
                    at = at[wanted.has(W.rolling(h, m)[at], m)]
                    found.append((at, np.full(len(at), m), W.rolling(h, m)[at]))
                at, m, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, W.U))
                order = np.argsort(at, kind="stable")
                at, m, s = at[order], m[order], s[order]
                row = row_of[at]
                wide = np.where(m < shingle, 0, window - m)  # words that a window may have before or after the shingle
                before = np.minimum(wide, at - block.first[row])
                after = np.minimum(wide, block.first[row + 1] - at - m)
                run_of = W.runs(block, at - before, before + m + after) if len(at) else pa.array([], pa.string())
                fields = [pa.array(m, pa.int32()), pa.array(W.signed(s), pa.int64()), pa.array(at - block.first[row], pa.int32()), pa.array(before, pa.int32()), run_of]
                cells = pa.StructArray.from_arrays(fields, names=[f.name for f in PLACES.value_type])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(block.rows + 1)), pa.int32()), cells)
                part = b.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [ROW, *keep]), pa.array(block.counts(), pa.int64()), lists], names=[ROW, *keep, "__n_words", "__places"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the spans of each row that overlap or touch."""
    for b in batches:
        lists = b.column("spans")
        flat = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).to_numpy())
        start, end = (flat.field(i).to_numpy() for i in (0, 1))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        base = row.astype(np.int64) << 40
        new = np.ones(len(row), bool)
        new[1:] = (base + start)[1:] > np.maximum.accumulate(base + end)[:-1]
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(end, first) if len(first) else end
        start, row = start[first], row[first]
        cells = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), cells)
        n_hit = np.bincount(row, end - start, b.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(ROW), pa.array(n_hit), spans, b.column("items")], names=[ROW, "__n_hit", "__spans", "__items"])


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Return the columns ``keep`` of ``docs`` (all, if not given) and n_words, n_hit, spans, items of each document.

    ``spans`` are the word ranges inside item windows and ``items`` the ids of these items, in order. Columns of
    ``docs`` by these names are replaced.
    """
    spark, added = docs.sparkSession, {"n_words", "n_hit", "spans", "items"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    every = cut(items.mapInArrow(_item_windows(window, shingle), "item string, n int, m int, words string, shingles array<long>"), "items")
    windows = every.groupBy("words").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("shingles").alias("shingles"), F.array_sort(F.collect_set("item")).alias("items"))
    windows = cut(windows, "windows")

    # Rarity, and each window's rarest shingle.
    wanted = windows.select("m", F.explode("shingles").alias("shingle")).distinct()
    counts = docs.select("text").mapInArrow(_count(_sent_filter(spark, cut(wanted, "shingles"))), "m int, shingle long, c long")
    counts = cut(counts.groupBy("m", "shingle").agg(F.sum("c").alias("c")), "rarity")
    tokens = windows.select("words", "n", "m", F.posexplode("shingles").alias("place", "shingle")).join(counts, ["m", "shingle"])
    first = tokens.groupBy("words").agg(F.min(F.struct("c", "shingle", "place")).alias("p"), F.count(F.lit(1)).alias("held"))
    prefixes = windows.join(first, "words").where("held = n - m + 1").select("m", F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place"), "n", "words", "items")
    prefixes = cut(prefixes, "prefixes")

    # Places of prefixes in documents, joined with the windows and verified.
    sent = _sent_filter(spark, cut(prefixes.select("m", "shingle").distinct(), "prefix-shingles"))
    fields = [T.StructField(ROW, T.LongType()), *(docs.schema[c] for c in keep), T.StructField("__n_words", T.LongType())]
    schema = T.StructType([*fields, T.StructField("__places", T._parse_datatype_string("array<struct<m:int,shingle:bigint,at:int,before:int,run:string>>"))])
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), *keep, F.col("text").alias(TEXT))
    rows = cut(rows.mapInArrow(_places(sent, keep, window, shingle), schema), "places")
    met = rows.select(ROW, F.explode("__places").alias("x")).select(ROW, "x.*").join(prefixes, ["m", "shingle"]).where("place <= before")
    here = F.array_join(F.slice(F.split("run", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ")
    start = (F.col("at") - F.col("place")).cast("long")
    found = met.where(here == F.col("words")).select(ROW, F.struct(start.alias("start"), (start + F.col("n")).alias("end")).alias("span"), "items")
    found = found.groupBy(ROW).agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = cut(found.mapInArrow(_merged, f"{ROW} long, __n_hit long, __spans {SPANS}, __items array<string>"), "hits")
    release(every, windows, counts, prefixes)
    out = rows.drop("__places").join(hits, ROW, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(*keep, F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"), none("__spans", SPANS).alias("spans"), none("__items", "array<string>").alias("items"))


def contaminated() -> Column:
    """The verdict on rows of :func:`overlaps`: a hit, and a twentieth of the words or more hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for :func:`digest`, for tables whose ids differ."""
    words = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
    WITH items AS (SELECT item_id, {words} AS ws FROM benchmark WHERE text IS NOT NULL),
    sized AS (SELECT *, least({window}, len(ws)) AS n FROM items WHERE len(ws) > 0),
    windows AS (
      SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
    cells AS (SELECT doc_id, coalesce({words}, []::VARCHAR[]) AS ws FROM documents),
    lengths AS (SELECT DISTINCT n FROM windows),
    runs AS (
      SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
      FROM (SELECT c.*, l.n, unnest(range(1, len(ws) - l.n + 2)) AS i FROM cells c, lengths l)),
    met AS (SELECT r.doc_id, r.i, r.n, w.item_id FROM runs r JOIN windows w ON r.n = w.n AND r.w = w.w),
    hits AS (
      SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM met) GROUP BY doc_id),
    found AS (
      SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT c.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM cells c LEFT JOIN hits h ON h.doc_id = c.doc_id LEFT JOIN found f ON f.doc_id = c.doc_id"""
