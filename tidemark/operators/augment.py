"""Two jittered and masked views of each record, drawn from hashes so that every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X


def views(records: DataFrame, key: str = "seq", per_row: int = 1) -> DataFrame:
    """Rows twice, as views a and b of one ``pair_id``; with ``per_row`` pairs, ids stay distinct."""
    rows = records.withColumn("__pair", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    rows = rows.withColumn("pair_id", F.col(key).cast("long") * per_row + F.col("__pair")).drop("__pair")
    return rows.withColumn("view", F.explode(F.array(F.lit("a"), F.lit("b"))))


def jitter(rows: DataFrame, seed: int = 0, low: float = C.JITTER_MINUTES[0], high: float = C.JITTER_MINUTES[1]) -> DataFrame:
    """Shift ``timestamp`` by low to high minutes either way, and take time features anew."""
    draw = lambda k: X.unit_draw(F.lit(seed + k), F.col("pair_id"), F.col("view"))
    micros = F.floor((low + (high - low) * draw(0)) * 60_000_000) * F.when(draw(1) < 0.5, -1).otherwise(1)
    rows = rows.withColumn("timestamp", F.timestamp_add("MICROSECOND", micros, F.col("timestamp")))
    return with_time_features(rows)


def with_time_features(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add hour_of_day (fractional), day_of_week and time2vec."""
    at = X.fractional_hour(F.col(ts))
    return rows.withColumns({"hour_of_day": at, "day_of_week": X.weekday(F.col(ts)).cast("double"), "time2vec": X.time2vec(at)})


def mask(rows: DataFrame, columns: list[str], seed: int = 0, ratio: tuple[float, float] = C.MASK_RATIO, fill: float = C.MASK_FILL) -> DataFrame:
    """Set one column or a drawn share of ``columns`` to ``fill``, and flag each in ``<column>_masked``."""
    draw = X.unit_draw(F.lit(seed + 7), F.col("pair_id"), F.col("view"))
    count = F.greatest(F.lit(1), F.bround((ratio[0] + (ratio[1] - ratio[0]) * draw) * len(columns)).cast("int"))
    ranked = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col("pair_id"), F.col("view"), F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in columns]))
    chosen = F.transform(F.slice(ranked, F.lit(1), count), lambda x: x["c"])
    rows = rows.withColumn("__masked", chosen)
    hit = lambda c: F.array_contains("__masked", c)
    return rows.withColumns({f"{c}_masked": hit(c).cast("double") for c in columns} | {c: F.when(hit(c), fill).otherwise(F.col(c)) for c in columns}).drop("__masked")


def flat_vector(columns: list[str], time2vec: Column | None = None) -> Column:
    """Values with their flags, hour, day, time2vec, as floats; null counts as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
    parts = [p for c in columns for p in (zero(c), zero(f"{c}_masked"))] + [zero("hour_of_day"), zero("day_of_week")]
    return F.concat(F.array(*parts), F.transform(F.col("time2vec") if time2vec is None else time2vec, lambda x: x.cast("float")))


def pairs(records: DataFrame, columns: list[str], key: str = "seq", per_row: int = 1, epoch: int = 0) -> DataFrame:
    """Augmented pairs; another ``epoch`` gives fresh views of the same records."""
    return mask(jitter(views(records, key, per_row), seed=1000 * epoch), columns, seed=1000 * epoch)
