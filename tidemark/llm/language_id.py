"""Language identification with bit-sliced Bloom filters.

A filter's slot holds one bit for each language, so one read of a slot serves all languages: the languages that hold an
n-gram are the conjunction of the masks in its slots. A document's n-grams are letter trigrams in lower case, with
anything else than a letter as a boundary. For each language its hits are counted over the document, the hits that the
filter's known fill would give by chance are taken off, and the language with most hits left wins. The score is its
part of all corrected hits.

A language's filter holds its ``PROFILE`` most frequent trigrams, without those that are more than ``RATIO`` times as
frequent in another language. They are counted on a sample of at most about ``SAMPLE`` labelled documents a language,
chosen by hash; that bound is what makes the model's size independent of the corpus.

A null text, or one without letters, is ``und`` with score 0; so is every text if nothing could be learned. A document
without hits gets the most frequent learned language with score 0. Rows without an id or a language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words as W

PROFILE, RATIO, SAMPLE = 8192, 3.0, 4000
SLOTS, PROBES = 1 << 18, 2
UND = "und"
_LETTER: list[np.ndarray] = []


def remainder(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every trigram whose middle is a letter."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    is_letter = _letters()[points]
    c = np.concatenate([[0], np.where(is_letter, points, 0), [0]]).astype(W.U)
    at = np.flatnonzero(is_letter)
    h = (c[at] * W.U(0x9E3779B97F4A7C15)) ^ (c[at + 1] * W.U(0xC2B2AE3D27D4EB4F)) ^ (c[at + 2] * W.U(0x165667B19E3779F9))
    return row[at], W.mix(h)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in W.slices(whole, ["text"], 1 << 21):
            row, h = trigrams(part.column("text").to_pylist())
            names, which = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
            for k, name in enumerate(names):
                gram, c = np.unique(h[which[row] == k], return_counts=True)
                yield W.batch({"lang": ([str(name)] * len(gram), pa.string()), "gram": (W.signed(gram), pa.int64()), "c": (c, pa.int64())})


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # (words of 64 languages, slots)
    chance: np.ndarray  # of each language: how likely a gram that it does not hold hits it

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> W.U(20 * i)) & W.U(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]

    @staticmethod
    def build(languages: list[str], grams: list[np.ndarray]) -> Filters:
        masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), W.U)
        chance = np.zeros(len(languages))
        for k, g in enumerate(grams):
            bit = W.U(1 << (k % 64))
            for at in Filters.places(g):
                masks[k // 64, at] |= bit
            chance[k] = ((masks[k // 64] & bit) > 0).mean() ** PROBES
        return Filters(languages, masks, chance)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        row, h = trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        found = np.ones((len(self.masks), len(h)), W.U) * W.U(2**64 - 1)
        for at in self.places(h):
            found &= self.masks[:, at]
        hits = np.stack([np.bincount(row, (found[k // 64] >> W.U(k % 64)) & W.U(1), len(texts)) for k in range(len(self.languages))], axis=1)
        left = np.maximum(0, (hits - n[:, None] * self.chance) / (1 - self.chance))
        best, total = left.argmax(axis=1), left.sum(axis=1)
        score = np.divide(left.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        return [self.languages[k] if c else UND for k, c in zip(best, n, strict=True)], [float(s) if c else 0.0 for s, c in zip(score, n, strict=True)]


def learn(labelled: DataFrame, sample: int = SAMPLE, profile: int = PROFILE, ratio: float = RATIO) -> Filters:
    """Fit filters on rows (doc_id, text, lang)."""
    labelled = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    if not sizes:
        return Filters([], np.zeros((1, SLOTS), W.U), np.zeros(0))
    part = F.lit(0.0)
    for r in sizes:
        part = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["count"]))).otherwise(part)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counts = labelled.where(draw < part).select("text", "lang").mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("lang"))
    counts = counts.withColumn("share", share)
    counts = counts.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") * ratio >= F.col("top"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram"))
    chosen = counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram").toPandas()  # profile rows a language
    names = [r["lang"] for r in sizes]
    return Filters.build(names, [chosen.loc[chosen["lang"] == n, "gram"].to_numpy(np.int64).view(W.U) for n in names])


def identify(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """Return the columns ``keep`` of ``docs`` (all, if not given) with lang_pred and score, which replace their like."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.chance))  # a fixed number of slots, as plain arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*sent.value)
        for whole in batches:
            for part in W.slices(whole, ["__text"], 1 << 19):
                lang, score = filters.predict(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
