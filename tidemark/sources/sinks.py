"""Sinks: Parquet, JSON lines, dead letters, summaries, model registry."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def kafka(df: DataFrame, servers: str, topic: str, format: str = "kafka", **options: str) -> int:
    """Write ``payload`` to a topic and return how many were delivered; needs Spark's Kafka package on the class path.

    The write returns once the brokers have confirmed every row and fails otherwise, so all are delivered or none counts.
    """
    sent = Observation()
    rows = df.select(F.col("payload").alias("value")).observe(sent, F.count(F.lit(1)).alias("n"))
    rows.write.format(format).mode("append").options(**{"kafka.bootstrap.servers": servers, "topic": topic} | options).save()
    return sent.get["n"]


def corpus(df: DataFrame, path: str, summary: DataFrame) -> None:
    """The corpus and its one-row summary beside it."""
    parquet(df, f"{path}/corpus")
    summary.withColumn("output_path", F.lit(f"{path}/corpus")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def isolated(on_batch: Callable[[DataFrame, int], None], reraise: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. With ``reraise`` a failed batch is tried again by Spark, otherwise it is passed over."""

    def run(df: DataFrame, batch_id: int) -> None:
        try:
            on_batch(df, batch_id)
        except Exception:
            if reraise:
                raise

    return run


def _replace(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)


def feature_meta(path: str, vocabulary: DataFrame, stats: DataFrame) -> None:
    """Write vocabularies and [mean, std] lists, which are bounded by the number of labels, as one JSON document."""
    vocab: dict[str, dict[str, int]] = {}
    for r in vocabulary.orderBy("column", "idx").collect():
        vocab.setdefault(r["column"], {})[r["label"]] = r["idx"]
    _replace(Path(path), json.dumps({"vocab_maps": vocab, "metric_value_stats": {r["metric_name"]: [r["mean"], r["std"]] for r in stats.collect()}}))


class Registry:
    """Model versions in one manifest; every change replaces the file as a whole, so a reader sees the old or the new."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def _read(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {"latest_version": None, "artifacts": {}}

    def register(self, version: str, entry: dict) -> None:
        """Add or replace a version and make it the latest."""
        manifest = self._read()
        manifest["artifacts"][version] = {k: v.replace("\\", "/") if k.endswith("_path") else v for k, v in entry.items()}
        manifest["latest_version"] = version
        _replace(self.path, json.dumps(manifest, indent=1))

    def get(self, version: str) -> dict:
        found = self._read()["artifacts"]
        if version not in found:
            raise KeyError(f"no version {version}")
        return found[version]

    def latest(self) -> dict:
        """By the manifest's pointer, not by the order of version strings."""
        version = self._read()["latest_version"]
        if version is None:
            raise LookupError("nothing is registered")
        return self.get(version)

    def versions(self) -> list[str]:
        return sorted(self._read()["artifacts"])
