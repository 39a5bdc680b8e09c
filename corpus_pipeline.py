"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut
from tidemark.llm import decontaminate, language_id, line_dedup, mixing, near_dedup

#: A document in no learned language spreads its corrected hits evenly; below this part the prediction says nothing.
LEAST_SCORE = 0.3
ORACLE_SQL = None


def _apart(docs: DataFrame, added: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a stage whose operator adds columns, and return the columns of ``docs``, even those of these names."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in added}
    out = stage(docs.withColumnsRenamed(clash))
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages.

    Null texts and texts without letters are in none and go; every row is judged by itself, so repeated rows share a verdict.
    If no document has a language, nothing is learned and nothing is kept.
    """
    filters = language_id.learn(docs.where(language_id.remainder() != 0))
    known = (F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)
    return _apart(docs, ["lang_pred", "score"], lambda d: language_id.identify(d, filters).where(known))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; ``n_chars`` follows the text.

    All rows stay, those whose text is emptied too. A null source is one more site; repeated rows are cleaned alike.
    """
    out = _apart(docs, ["n_lines", "n_removed"], line_dedup.remove_boilerplate)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the least id; of repeated rows one stays.

    A text that an earlier stage emptied has no near duplicates and stays. An id of null comes after all others.
    """
    # Rows are numbered once, in a written table: ids drawn again by another scan may differ.
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    first = cut(near_dedup.near_duplicates(numbered, row="__row").where("is_first").select(F.col("row").alias("__row")), "first")
    return numbered.join(first.hint("shuffle_hash"), "__row", "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by benchmark items. Null texts have no words and stay; repeated rows share a verdict."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = decontaminate.overlaps(keyed, items, keep=["__key"]).where(decontaminate.contaminated())
    return keyed.join(cut(found.select("__key").distinct(), "contaminated"), "__key", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their targets; a row for every document, those that the mix does not take with 0 words."""
    return mixing.fair_queue(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
