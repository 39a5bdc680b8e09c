"""Checks of arguments and of tables, made on the driver, and checks of data, made where the data is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """The required columns that ``df`` lacks, in order."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """``df`` itself, or a ValueError that names what it lacks and what it has."""
    if lacking := missing_columns(df, required):
        raise ValueError(f"missing column(s): {lacking}; found: {sorted(df.columns)}")
    return df


def require_positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")


def of_width(vector: Column, width: int) -> Column:
    """The vector; a row whose vector has another width, or none, fails the job."""
    wrong = F.concat(F.lit(f"expected a vector of width {width}, got "), F.coalesce(F.size(vector).cast("string"), F.lit("none")))
    return F.when(F.coalesce(F.size(vector) == width, F.lit(False)), vector).otherwise(F.raise_error(wrong))


def frame(spark: SparkSession, rows, required: Iterable[str] = ()) -> DataFrame:
    """A pandas frame as a DataFrame; anything else is a TypeError."""
    import pandas as pd

    if not isinstance(rows, pd.DataFrame):
        raise TypeError(f"expected a pandas DataFrame, got {type(rows).__name__}")
    return require_columns(spark.createDataFrame(rows), required)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a hash of their key, the same ones each time."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)
