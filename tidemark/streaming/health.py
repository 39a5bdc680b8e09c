"""Health of the ingestion: running counters, and processing-time batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark import config as C
from tidemark.operators import ingest

METRICS = "ingest"


class Health(StreamingQueryListener):
    """Counts received and invalid lines of streams that are observed under ``METRICS``; add it to ``spark.streams``."""

    def __init__(self) -> None:
        self.received = self.invalid = self.batches = 0
        self._lock = threading.Lock()

    def count(self, received: int, invalid: int) -> None:
        with self._lock:
            self.received, self.invalid, self.batches = self.received + received, self.invalid + invalid, self.batches + 1

    @property
    def error_rate(self) -> float:
        """Invalid lines by received ones; 0 before the first."""
        with self._lock:
            return self.invalid / self.received if self.received else 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is not None and row["received"]:
            self.count(row["received"], row["invalid"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(lines: DataFrame) -> DataFrame:
    """Validated lines of a stream, observed for :class:`Health`."""
    return ingest.observed(ingest.validate(lines), METRICS)


def on_interval(on_batch: Callable[[DataFrame, dict], None], source: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for validated lines: valid records, and (source, batch_ts, n_valid, n_invalid).

    A batch of invalid lines only is handed on with its count; an empty one is not.
    """

    def run(df: DataFrame, batch_id: int) -> None:
        held = df.persist()
        try:
            n = held.agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("invalid"), F.current_timestamp().alias("at")).first()
            if n["valid"] or n["invalid"]:
                on_batch(ingest.valid(held), {"source": source, "batch_id": batch_id, "batch_ts": n["at"], "n_valid": n["valid"], "n_invalid": n["invalid"]})
        finally:
            held.unpersist()

    return run


def start(lines: DataFrame, on_batch: Callable[[DataFrame, dict], None], checkpoint: str, source: str, seconds: int = C.BATCH_SECONDS):
    """Batches of processing time: the next interval begins when a batch has been handed on."""
    writer = watched(lines).writeStream.foreachBatch(on_interval(on_batch, source)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
