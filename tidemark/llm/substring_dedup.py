"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes when a window that covers it also starts in a
document with a smaller id. Windows are judged on the input.

1. *Confirm recurring passages.* Each window is owned by its anchor, the ``seed``-word run in it whose hash is least,
   so equal windows have equal anchors; a run of windows with one anchor is a passage. Anchors seen in one document
   only are dropped by an aggregation. What is left is matched passage by passage, and, where an anchor has several
   passages, window by window, always against the smallest document that has it. Neighbouring matches are chained.
2. *Compile sharded automata.* Documents are dealt to shards by hash, and a chain's phrase, the words of the earlier
   document, goes to the shards that need it, once each. A shard's phrases become one Aho-Corasick automaton over
   numbered words.
3. *Stream all documents* through the automaton of their shard. A phrase found in a document with a larger id than
   the phrase's own covers its words: only words compared one by one are ever removed.

Matches are kept by aggregated minima and joins on (anchor, passage), which Spark can split; no group of copies is
gathered. A task holds one shard's automaton and one batch of documents.

Null and empty texts have no words. A document without an id has no order: it keeps its words and removes none.
Repeated rows and rows that share an id count as one document and give a row each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut, release
from tidemark.llm import words as W

SEED = 8
DOCS_PER_SHARD = 512
PIECE = 1 << 16  # window rows in a batch


def _passages(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.space_table()
        for b in batches:
            doc, rid = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("rid").to_numpy(zero_copy_only=False)
            for block in W.blocks(b.column("text"), table):
                at = W.inside_row(block, window)
                if not len(at):
                    continue
                h = block.hashes()
                whole = W.rolling(h, window)
                anchor = W.sliding_min(W.rolling(h, seed), window - seed + 1)
                row = block.row_of_word()[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[1:] != row[:-1])
                lo = np.flatnonzero(new)
                n = np.diff(np.append(lo, len(at)))
                total = np.append(W.U(0), np.cumsum(whole[at], dtype=W.U))
                first, last = at[lo], at[lo + n - 1]
                same = W.mix(W.mix(whole[first] + n.astype(W.U)) ^ (whole[last] * W.U(31)) ^ (total[lo + n] - total[lo]))
                r = row[lo]
                yield W.batch({
                    "doc_id": (doc[block.lo + r], pa.int64()), "rid": (rid[block.lo + r], pa.int64()),
                    "s": ((first - block.first[r]).astype(np.int32), pa.int32()), "n": (n.astype(np.int32), pa.int32()),
                    "anchor": (W.signed(anchor[first]), pa.int64()), "same": (W.signed(same), pa.int64()),
                })

    return run


def _cells(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(number of structs in each list, their fields as arrays)."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return lengths, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _windows(window: int):
    """Windows of the asked passages of each document: (anchor, window hash, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = W.space_table()
        for b in batches:
            doc, rid = b.column("doc_id").to_numpy(), b.column("rid").to_numpy()
            for block in W.blocks(b.column("text"), table):
                whole = W.rolling(block.hashes(), window)
                lengths, cell = _cells(b.column("asked").slice(block.lo, block.rows))
                which, step = W.spread(cell["n"])
                row = np.repeat(np.arange(block.rows), lengths)[which]
                for lo in range(0, len(which), PIECE):
                    w, r = which[lo : lo + PIECE], row[lo : lo + PIECE]
                    at = cell["s"][w] + step[lo : lo + PIECE]
                    yield W.batch({
                        "anchor": (cell["anchor"][w], pa.int64()), "wh": (W.signed(whole[block.first[r] + at]), pa.int64()), "doc_id": (doc[block.lo + r], pa.int64()),
                        "rid": (rid[block.lo + r], pa.int64()), "s": (at.astype(np.int32), pa.int32()),
                    })

    return run


def _chains(window: int):
    """Join a document's neighbouring matches with one earlier document into (owner, first word, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                lengths, c = _cells(b.column("found"))
                shard, row = b.column("shard").to_numpy(), np.repeat(np.arange(b.num_rows), lengths)
                shift = c["o_s"].astype(np.int64) - c["s"]
                order = np.lexsort((c["o_s"], shift, c["o_rid"], c["o_doc"], row))
                keys = [k[order] for k in (row, c["o_doc"], c["o_rid"], shift)]
                start = c["o_s"][order].astype(np.int64)
                end = start + c["n"][order]
                if not len(start):
                    continue
                # Ends so far within a key: keys are numbered, and each one's ends lie above those of the keys before.
                new = np.ones(len(start), bool)
                new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
                base = np.cumsum(new) << 32
                reach = np.maximum.accumulate(base + end)
                new[1:] |= base[1:] + start[1:] > reach[:-1]
                first = np.flatnonzero(new)
                last = np.maximum.reduceat(end, first)
                yield W.batch({
                    "shard": (shard[keys[0][first]], pa.int64()), "o_doc": (keys[1][first], pa.int64()), "o_rid": (keys[2][first], pa.int64()),
                    "o_s": (start[first].astype(np.int32), pa.int32()), "words": ((last - start[first] + window - 1).astype(np.int32), pa.int32()),
                })

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases asked of each document, as its text has them."""
    table = W.space_table()
    for b in batches:
        doc, rid = b.column("doc_id").to_numpy(), b.column("rid").to_numpy()
        for block in W.blocks(b.column("text"), table):
            lengths, cell = _cells(b.column("asked").slice(block.lo, block.rows))
            row = np.repeat(np.arange(block.rows), lengths)
            first = block.first[row] + cell["o_s"]
            start, end = block.start[first], block.end[first + cell["words"] - 1]
            data = block.data.tobytes()
            for part in _parts(end - start):
                yield W.batch({
                    "o_doc": (doc[block.lo + row[part]], pa.int64()), "o_rid": (rid[block.lo + row[part]], pa.int64()),
                    "o_s": (cell["o_s"][part], pa.int32()), "words": (cell["words"][part], pa.int32()),
                    "phrase": ([data[x:y] for x, y in zip(start[part].tolist(), end[part].tolist(), strict=True)], pa.string()),
                })


def _parts(sizes: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    """Cut rows into parts of about ``most`` bytes."""
    upto, lo = np.append(0, np.cumsum(sizes)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield slice(lo, hi)
        lo = hi


class _Shard:
    """One shard's phrases as an automaton over numbered words."""

    def __init__(self) -> None:
        self.phrases: dict[bytes, int] = {}  # a phrase is its words' numbers, four bytes each
        self.number: dict[bytes, int] = {}
        self.automaton = None

    def add(self, phrase: bytes, owner: int) -> None:
        number = self.number
        key = np.array([number.setdefault(w, len(number) + 1) for w in phrase.split()], np.int32).tobytes()
        self.phrases[key] = min(owner, self.phrases.get(key, owner))

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        while self.phrases:
            key, owner = self.phrases.popitem()
            self.automaton.add_word(tuple(np.frombuffer(key, np.int32).tolist()), (len(key) // 4, owner))
        if len(self.automaton):
            self.automaton.make_automaton()

    def covered(self, doc: int | None, cells: list[bytes]) -> bytearray | None:
        if self.automaton is None:
            self.compile()
        if doc is None or not len(self.automaton) or not cells:
            return None
        number, hit = self.number, None
        for end, (n, owner) in self.automaton.iter(tuple([number.get(w, 0) for w in cells])):
            if owner < doc:
                hit = hit or bytearray(len(cells))
                hit[end - n + 1 : end + 1] = b"\1" * n
        return hit


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream each shard's documents, which follow its phrases, through its automaton."""
    at, shard = None, _Shard()
    for b in (part for whole in batches for part in W.slices(whole, ["text"])):
        out = []
        for k, is_doc, doc, text in zip(b.column("shard").to_pylist(), b.column("is_doc").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            if k != at:
                at, shard = k, _Shard()
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if not is_doc:
                shard.add(raw, doc)
                continue
            cells = raw.split()
            hit = shard.covered(doc, cells)
            kept = cells if hit is None else [w for w, h in zip(cells, hit, strict=True) if not h]
            out.append((doc, b" ".join(kept), len(cells), len(cells) - len(kept), _spans(hit)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield W.batch({
            "doc_id": (cols[0], pa.int64()), "kept_text": (cols[1], pa.string()), "n_words": (cols[2], pa.int64()),
            "n_removed": (cols[3], pa.int64()), "removed": (cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })


def _spans(hit: bytearray | None) -> list[dict]:
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.frombuffer(bytes(1) + bytes(hit) + bytes(1), np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = SEED, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Return (doc_id, kept_text, n_words, n_removed, removed): the words left, and the word ranges taken out.

    ``docs`` needs doc_id and text; see the module for the method and for edge cases.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be from 1 to window")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rid"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    shards = max(1, docs.count() // docs_per_shard)
    shard_of = F.pmod(F.xxhash64(F.col("rid"), F.lit(1)), F.lit(shards)).alias("shard")

    # Passages whose anchor is in several documents.
    every = cut(known.mapInArrow(_passages(window, seed), "doc_id long, rid long, s int, n int, anchor long, same long"), "passages")
    spread = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    spread = cut(spread, "anchors")
    again = cut(every.join(spread, "anchor", "left_semi"), "recurring")
    release(every)
    release(spread)

    # The smallest document of each passage; of passages that share an anchor, the smallest of each window.
    own = again.groupBy("anchor", "same").agg(F.min(F.struct("doc_id", "rid", "s")).alias("o"))
    own = cut(own.select("anchor", "same", F.col("o.doc_id").alias("o_doc"), F.col("o.rid").alias("o_rid"), F.col("o.s").alias("o_s")), "owners")
    whole = again.join(own.select("anchor", "same", "o_doc", "o_rid", "o_s"), ["anchor", "same"]).where("doc_id > o_doc")
    shared = cut(own.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "shared")
    texts = cut(known.join(again.select("doc_id", "rid").distinct(), ["doc_id", "rid"], "left_semi"), "texts")
    # Every row of the owner's id has to know which of the passage's windows an earlier document has.
    mine = again.join(own.join(shared, "anchor", "left_semi").select("anchor", "same", F.col("o_doc").alias("doc_id")), ["anchor", "same", "doc_id"])
    asked = mine.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("s", "n", "anchor")).alias("asked"))
    one = texts.dropDuplicates(["doc_id", "rid"])
    single = cut(one.join(asked, ["doc_id", "rid"]).mapInArrow(_windows(window), "anchor long, wh long, doc_id long, rid long, s int"), "windows")
    found_least = cut(single.groupBy("anchor", "wh").agg(F.min(F.struct("doc_id", "rid", "s")).alias("o"), F.max("doc_id").alias("hi")).where("o.doc_id < hi"), "least")
    least = found_least.select("anchor", "wh", F.col("o.doc_id").alias("o_doc"), F.col("o.rid").alias("o_rid"), F.col("o.s").alias("o_s"))
    parts = single.join(least, ["anchor", "wh"]).where("doc_id > o_doc").withColumn("n", F.lit(1))

    # Chains of matches, and which shard needs which phrase.
    columns = ["doc_id", "rid", "s", "n", "o_doc", "o_rid", "o_s"]
    found = whole.select(columns).unionByName(parts.select(columns)).groupBy("doc_id", "rid")
    found = found.agg(F.collect_set(F.struct("s", "n", "o_doc", "o_rid", "o_s")).alias("found")).select(shard_of, "found")
    wanted = cut(found.mapInArrow(_chains(window), "shard long, o_doc long, o_rid long, o_s int, words int").distinct(), "wanted")
    phrase_key = ["o_doc", "o_rid", "o_s", "words"]
    per_owner = wanted.select(phrase_key).distinct().groupBy(F.col("o_doc").alias("doc_id"), F.col("o_rid").alias("rid"))
    per_owner = per_owner.agg(F.collect_list(F.struct("o_s", "words")).alias("asked"))
    phrases = cut(one.join(per_owner, ["doc_id", "rid"]).mapInArrow(_phrases, "o_doc long, o_rid long, o_s int, words int, phrase string"), "phrases")
    sent = wanted.join(phrases, phrase_key).select("shard", F.lit(False).alias("is_doc"), F.col("o_doc").alias("doc_id"), F.col("phrase").alias("text"))

    # Automata, and the documents streamed through them.
    sent = cut(sent, "sent")
    release(again, own, shared, texts, single, found_least, wanted, phrases)
    rows = docs.select(shard_of, F.lit(True).alias("is_doc"), "doc_id", "text").unionByName(sent)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "is_doc")
    return rows.mapInArrow(_locate, "doc_id long, kept_text string, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>")


def oracle(window: int = 50) -> str:
    """DuckDB SQL for the digest of :func:`remove_repeats`, for tables whose ids differ."""
    return rf"""
    WITH cells AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
    windows AS (
      SELECT doc_id, i, md5(array_to_string(ws[i : i + {window - 1}], ' ')) AS h
      FROM (SELECT *, unnest(range(1, len(ws) - {window - 2})) AS i FROM cells)),
    first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
    gone AS (
      SELECT DISTINCT doc_id, i + k AS place FROM (
        SELECT w.doc_id, w.i, unnest(range({window})) AS k FROM windows w JOIN first f ON w.h = f.h AND f.least < w.doc_id)),
    spread AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM cells),
    marked AS (SELECT s.*, g.place IS NOT NULL AS is_gone FROM spread s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place),
    kept AS (
      SELECT doc_id, count(*) FILTER (is_gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT is_gone), '') AS kept
      FROM marked GROUP BY doc_id)
    SELECT c.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM cells c LEFT JOIN kept k ON k.doc_id = c.doc_id"""
