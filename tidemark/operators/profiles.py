"""Entity profiles: the store, full builds, the periodic refresh, and incremental updates.

A profile is (entity_id, centroid, variance, n_records, history, cold_start). The store keeps versions of the whole table;
a version is written as a whole before readers see it, so a refresh that fails leaves the last one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.guards import require_columns
from tidemark.functions.scratch import cut
from tidemark.operators import vectors as V

COLUMNS = ["entity_id", "centroid", "variance", "n_records", "history", "cold_start"]
SCHEMA = "entity_id string, centroid array<double>, variance double, n_records int, history array<array<float>>, cold_start boolean"


def typed(profiles: DataFrame) -> DataFrame:
    fields = [part.strip().split(" ", 1) for part in SCHEMA.split(", ")]
    return require_columns(profiles, COLUMNS).select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


class EntityStore:
    """Profiles under a folder that all machines share; ``keep`` versions stay."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        if not self._files.exists(self._at):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in self._files.listStatus(self._at) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if self._files.exists(path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """All profiles; none before the first write."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]:08d}")

    def fetch(self, entities: DataFrame) -> DataFrame:
        """The profiles of (entity_id) rows that have one."""
        return self.read().join(entities.select("entity_id").distinct(), "entity_id", "left_semi")

    def known(self) -> DataFrame:
        return self.read().select("entity_id")

    def write(self, profiles: DataFrame) -> None:
        """Add profiles, or replace those of the same entities."""
        profiles = typed(profiles)
        versions = self.versions()
        if versions:
            old = self.read().join(profiles.select("entity_id"), "entity_id", "left_anti")
            profiles = old.unionByName(profiles)
        profiles.write.mode("overwrite").parquet(f"{self.path}/v{(versions[-1] if versions else 0) + 1:08d}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old_version in self.versions()[: -self.keep]:
            self._files.delete(path(f"{self.path}/v{old_version:08d}"), True)


def look_back(records: DataFrame, as_of: Column, days: int = C.HISTORY_DAYS, ts: str = "timestamp") -> DataFrame:
    """Records of the ``days`` before ``as_of``, which is an argument so that a build can be repeated."""
    return records.where((F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= as_of))


def full_build(vectors: DataFrame, known: DataFrame, order: str = "seq") -> DataFrame:
    """Profiles of all ``known`` (entity_id) from the vectors of the look-back.

    An entity without vectors is a cold start at the mean of all.
    """
    known = known.select("entity_id").distinct()
    mine = vectors.join(known, "entity_id", "left_semi")
    return typed(V.profiles(mine, order=order)).unionByName(typed(V.cold_profiles(known, vectors)))


def refresh(store: EntityStore, vectors: DataFrame, known: DataFrame, order: str = "seq") -> None:
    """Build every known entity anew, those of the store too, and write one version."""
    store.write(full_build(vectors, known.select("entity_id").unionByName(store.known()), order))


def incremental(prior: DataFrame, new: DataFrame, asked: DataFrame, look_back_vectors: DataFrame, order: str = "seq", n: int = C.HISTORY) -> DataFrame:
    """Profiles of the ``asked`` (entity_id), with ``drift_alarm``.

    New vectors are folded into the prior centroid and appended to the prior history, of which the last ``n`` stay;
    variance and count are those of the new history. Three kinds of entities are built in full from the look-back
    instead, without an alarm: those without a prior profile, those whose prior is a cold start, and those without
    new vectors.
    """
    asked = asked.select("entity_id").distinct()
    warm = prior.where("NOT cold_start").join(new.select("entity_id").distinct(), "entity_id", "left_semi").join(asked, "entity_id", "left_semi")
    warm = cut(typed(warm), "warm")
    mine = new.join(warm.select("entity_id"), "entity_id", "left_semi")
    folded = V.ema_update(warm, mine, order=order).select("entity_id", "centroid", "drift_alarm")
    before = warm.select("entity_id", F.posexplode("history").alias("place", "embedding")).select("entity_id", F.lit(0).alias("late"), F.col("place").cast("long").alias("place"), "embedding")
    after = mine.select("entity_id", F.lit(1).alias("late"), F.col(order).cast("long").alias("place"), F.col("embedding").cast("array<float>").alias("embedding"))
    history = before.unionByName(after).withColumn("at", F.struct("late", "place"))
    kept = V.profiles(history, order="at", n=n).drop("centroid", "cold_start")
    updated = folded.join(kept, "entity_id").withColumn("cold_start", F.lit(False))
    rest = full_build(look_back_vectors, asked.join(warm.select("entity_id"), "entity_id", "left_anti"), order)
    return typed(updated).join(folded.select("entity_id", "drift_alarm"), "entity_id").unionByName(rest.withColumn("drift_alarm", F.lit(False)))


def update(store: EntityStore, new: DataFrame, asked: DataFrame, look_back_vectors: DataFrame, order: str = "seq") -> DataFrame:
    """:func:`incremental` on the store; writes the profiles and returns (entity_id, drift_alarm)."""
    out = cut(incremental(store.fetch(asked), new, asked, look_back_vectors, order), "updated")
    store.write(out)
    return out.select("entity_id", "drift_alarm")
