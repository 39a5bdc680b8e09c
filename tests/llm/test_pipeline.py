"""The pipeline's stages on edge cases, and the queries' SQL."""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, mixing, near_dedup, queries

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages_keep_columns_and_take_effect(spark, stored, tmp_path):
    items = spark.createDataFrame([(1, " ".join(stored.where("doc_id = 33").first()["text"].split()[-40:]))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = stored, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert (out.columns, [f.dataType for f in out.schema]) == (docs.columns, [f.dataType for f in docs.schema])
            out.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            counts.append(docs.count())
        if name == "language_id":
            assert docs.where("text IS NULL OR trim(text) = ''").count() == 0
        if name == "line_dedup":
            assert docs.where("text LIKE '%footer line%'").count() in (0, 8) and docs.where("n_chars <> length(text)").count() == 0
        if name == "near_dedup":
            again = near_dedup.near_duplicates(docs)
            assert again.where("class_id <> doc_id").count() == 0 and docs.select("n_words").distinct().first()[0] == "own"
        if name == "decontaminate":
            assert decontaminate.overlaps(docs, items).where(decontaminate.contaminated()).count() == 0
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[3] < counts[2]
    assert out.count() == counts[-1]


def plain_lines(docs: list[dict]) -> list[dict]:
    sites = defaultdict(set)
    for d in docs:
        for line in d["text"].split("\n"):
            sites[line.strip(" \t\r\v\f")].add(d["source"])
    kept = lambda t: "\n".join(x for x in t.split("\n") if len(sites[x.strip(" \t\r\v\f")]) < 10 or not x.strip(" \t\r\v\f"))
    return [d | {"text": kept(d["text"])} for d in docs]


def plain_near_duplicates(docs: list[dict]) -> list[dict]:
    shingles, parent = {}, {}
    for d in docs:
        w = WORD.findall(d["text"])
        shingles[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[d["doc_id"]] = d["doc_id"]

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in shingles.items():
        for b, y in shingles.items():
            if a < b and x and y and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_decontamination(docs: list[dict], items: list[str]) -> list[dict]:
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: ITEM_WORD.findall((t or "").translate(low))
    windows = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_pipeline_against_plain_python(spark):
    """All stages after language ID, whose own test is below, worked off in plain Python and SQL on a whole table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.cut(corpus_pipeline.language(spark, docs, str(DATA)), "first")
    kept = [r.asDict() for r in first.collect()]
    assert 0.9 * docs.count() < len(kept)  # these documents are in four languages
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    lined = plain_lines(kept)
    single = plain_near_duplicates(lined)
    clean = plain_decontamination(single, items)
    assert lined != kept and len(clean) < len(single) < len(lined)
    con = duckdb.connect()
    con.register("clean", pa.Table.from_pylist([{k: d[k] for k in ("doc_id", "text", "source")} for d in clean]))
    sql = con.execute(mixing.oracle(docs="clean"))
    names = [c[0] for c in sql.description]
    plain = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    want = sorted(plain(r) for r in sql.fetchall())
    assert sorted(plain(r) for r in corpus_pipeline.run(spark, str(DATA)).select(*names).collect()) == want


def test_near_duplicates_when_files_are_packed_anew(spark, stored, monkeypatch):
    """Another packing of files into splits, between the scan that numbers rows and the join, changes no row."""
    many = stored.repartition(9, "doc_id")
    folder = f"{corpus_pipeline.cut(many, 'many')._scratch_path}"
    docs = spark.read.parquet(folder)
    want = sorted(map(repr, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    first, found = near_dedup.near_duplicates, []

    def packed(*args, **kwargs):
        out = corpus_pipeline.cut(first(*args, **kwargs), "packed")
        found.append(out.count())
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    spark.conf.set("spark.sql.files.minPartitionNum", "9")
    monkeypatch.setattr(near_dedup, "near_duplicates", packed)
    try:
        got = sorted(map(repr, corpus_pipeline.near_duplicates(spark, spark.read.parquet(folder), "").collect()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found and len(got) == len(want)
    texts = lambda rows: sorted(r.split("text=")[1] for r in rows)
    assert texts(got) == texts(want)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    plain = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    want = sorted(plain(r) for r in found.fetchall())
    assert sorted(plain(r) for r in queries.queries()[name](spark, str(DATA)).select(*names).collect()) == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
