"""Streaming twins: keyed baselines with state, and event-time batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import config as C
from tidemark.operators import ingest

SCORED = "bucket string, timestamp timestamp, seq long, value double, n int, baseline_mean double, baseline_std double, z_score double, cold_start boolean, is_anomaly boolean"


def _scorer(method: str, window: int, threshold: float, min_samples: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(frames)).sort_values(["timestamp", "seq"])
        value = rows["value"].to_numpy(float)
        every = np.concatenate([np.full(window, np.nan), held, value])
        # What each reading finds: the window before it, filled up with nan where there are fewer.
        past = np.lib.stride_tricks.sliding_window_view(every[:-1], window)[len(held) :]
        n = np.minimum(len(held) + np.arange(len(value)), window)
        some = n > 0
        mean, std, mid, mad = (np.zeros(len(value)) for _ in range(4))
        mean[some] = np.nanmean(past[some], axis=1)
        spread = np.zeros(len(value), bool)
        spread[some] = np.nanmin(past[some], axis=1) < np.nanmax(past[some], axis=1)
        std[spread] = np.nanstd(past[spread], axis=1)
        if method == "zscore":
            z = np.divide(value - mean, std, out=np.zeros(len(value)), where=std > 0)
        else:
            mid[some] = np.nanmedian(past[some], axis=1)
            mad[some] = np.nanmedian(np.abs(past[some] - mid[some][:, None]), axis=1)
            z = np.divide(C.ROBUST_CONSTANT * (value - mid), mad, out=np.zeros(len(value)), where=mad > 0)
        cold = n < min_samples
        z[cold] = 0.0
        state.update((every[window:][-window:].tolist(),))
        yield pd.DataFrame({
            "bucket": key[0], "timestamp": rows["timestamp"].to_numpy(), "seq": rows["seq"].to_numpy(), "value": value, "n": n, "baseline_mean": mean, "baseline_std": std,
            "z_score": z, "cold_start": cold, "is_anomaly": np.abs(z) > threshold * (1 + 1e-12),
        })

    return run


def score_stream(points: DataFrame, method: str = "zscore", window: int = C.WINDOW_SAMPLES, threshold: float = C.Z_THRESHOLD, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """Score a stream of (bucket, timestamp, seq, value): each reading against the state before it, then update.

    One task owns a bucket, so state needs no locks. Within a micro-batch readings go by (timestamp, seq); across
    batches by arrival.
    """
    fn = _scorer(method, window, threshold, min_samples)
    return points.groupBy("bucket").applyInPandasWithState(fn, SCORED, "window array<double>", "append", GroupStateTimeout.NoTimeout)


def batch_stream(lines: DataFrame, at: str, watermark: str = "10 minutes", seconds: int = C.BATCH_SECONDS) -> DataFrame:
    """Event-time batches of validated lines, each sent once its watermark has passed."""
    checked = ingest.validate(lines.withWatermark(at, watermark))
    return ingest.batches(checked, at, seconds)


def dedup_stream(alerts: DataFrame, keys: list[str], ts: str = "timestamp", within: str = "300 seconds") -> DataFrame:
    """One alert of each fingerprint within a span of event time."""
    return alerts.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Work off what a stream has now into an in-memory table, for tests and small replays."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def sink(df: DataFrame, on_batch, checkpoint: str, seconds: int = C.BATCH_SECONDS):
    """Start a query that hands each micro-batch to ``on_batch``."""
    return df.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def dead_letter_sink(path: str):
    """A foreachBatch function that appends invalid lines to the dead-letter folder."""

    def run(df: DataFrame, batch_id: int) -> None:
        ingest.dead_letters(ingest.validate(df)).withColumn("batch_id", F.lit(batch_id)).write.mode("append").json(path)

    return run
