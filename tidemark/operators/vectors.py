"""Embedding vectors: pooling, profiles, exact and partitioned nearest neighbours."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.functions.guards import require_columns, require_positive
from tidemark.functions.scratch import cut

BROADCAST_QUERIES = 4096
PART = 16_384  # vectors of the corpus that a search holds at a time
ROUGH = 1 << 20  # numbers of a product of queries and a part
TRAIN_MOST = 1_000_000  # vectors that cell centres are learned from


def unpivoted(vectors: DataFrame, keep: list[str], column: str = "embedding") -> DataFrame:
    return vectors.select(*keep, F.posexplode(column).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def _gathered(rows: DataFrame, group: list[str], value: str = "x", name: str = "embedding") -> DataFrame:
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__v"))
    return packed.select(*group, F.transform("__v", lambda r: r[value]).alias(name))


def pool(vectors: DataFrame, key: str = "entity_id", column: str = "embedding") -> DataFrame:
    """(key, embedding, n_records): the mean of an entity's vectors, then unit length."""
    mean = unpivoted(vectors, [key], column).groupBy(key, "pos").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    packed = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("__v"), F.max("n").alias("n_records"))
    return packed.select(key, X.normalised(F.transform("__v", lambda r: r["x"])).alias("embedding"), "n_records")


def with_cloud(pooled: DataFrame, clouds: DataFrame, key: str = "entity_id") -> DataFrame:
    return pooled.join(clouds.select(key, "cloud_provider"), key, "left").withColumn("cloud_provider", F.coalesce("cloud_provider", F.lit("Unknown")))


def last_vectors(vectors: DataFrame, key: str, order: str, n: int = C.HISTORY) -> DataFrame:
    back = Window.partitionBy(key).orderBy(F.desc(order))
    return vectors.withColumn("__b", F.row_number().over(back)).where(F.col("__b") <= n).drop("__b")


def profiles(vectors: DataFrame, key: str = "entity_id", order: str = "seq", n: int = C.HISTORY, column: str = "embedding") -> DataFrame:
    """(key, centroid, variance, n_records, history) of the last ``n`` vectors; variance is the trace of the covariance."""
    recent = last_vectors(vectors, key, order, n)
    stats = unpivoted(recent, [key], column).groupBy(key, "pos").agg(F.avg("x").alias("x"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    packed = stats.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("__v"), F.sum("v").alias("variance"))
    history = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("e")))).alias("__h"))
    out = packed.join(history, key)
    return out.select(
        key, X.normalised(F.transform("__v", lambda r: r["x"])).alias("centroid"), "variance", F.size("__h").alias("n_records"),
        F.transform("__h", lambda r: r["e"]).alias("history"), F.lit(False).alias("cold_start"),
    )


def cold_profiles(entities: DataFrame, vectors: DataFrame, key: str = "entity_id", column: str = "embedding") -> DataFrame:
    """Profiles of entities without history: the normalised mean of all vectors (zeros if there are none)."""
    mean = unpivoted(vectors, [], column).groupBy("pos").agg(F.avg("x").alias("x"))
    centre = mean.agg(X.normalised(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"])).alias("centroid"))
    lone = entities.select(key).distinct().join(vectors.select(key).distinct(), key, "left_anti")
    empty = F.array().cast("array<array<float>>")
    return lone.crossJoin(centre).select(key, "centroid", F.lit(0.0).alias("variance"), F.lit(0).alias("n_records"), empty.alias("history"), F.lit(True).alias("cold_start"))


def ema_update(prior: DataFrame, new: DataFrame, key: str = "entity_id", order: str = "seq", alpha: float = C.CENTROID_ALPHA, stds: float = C.DRIFT_ALARM_STD, column: str = "embedding") -> DataFrame:
    """(key, centroid, drift_alarm, max_distance): new vectors folded one by one into the prior centroid.

    A vector farther from the running centroid than ``stds`` roots of the prior variance raises the alarm. The
    centroid is brought to unit length at the end only.
    """
    arrived = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("e")))).alias("__n"))
    rows = prior.select(key, "centroid", "variance").join(arrived, key)
    vectors = F.transform("__n", lambda r: F.transform(r["e"], lambda x: x.cast("double")))
    start = F.struct(F.transform("centroid", lambda x: x.cast("double")).alias("c"), F.lit(0.0).alias("far"))

    def fold(state, e):
        c = state["c"]
        moved = F.zip_with(e, c, lambda x, y: F.lit(alpha) * x + F.lit(1 - alpha) * y)
        return F.struct(moved.alias("c"), F.greatest(state["far"], F.sqrt(X.squared_distance(e, c))).alias("far"))

    rows = rows.withColumn("__s", F.aggregate(vectors, start, fold))
    far, spread = F.col("__s.far"), F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return rows.select(key, X.normalised(F.col("__s.c")).alias("centroid"), ((spread > 0) & (far > stds * spread)).alias("drift_alarm"), far.alias("max_distance"))


def _matrix(b: pa.RecordBatch, width: int | None = None) -> np.ndarray:
    values = np.asarray(b.column("embedding").flatten(), dtype=np.float64)
    width = len(values) // b.num_rows if width is None else width
    if len(values) != width * b.num_rows:
        raise ValueError(f"expected vectors of width {width}, got {len(values)} numbers in {b.num_rows} rows")
    return values.reshape(b.num_rows, width)


class _Part:
    """A part of the corpus, ready for blocks of queries. Of equal vectors of an owner only the k least ids can be among the k best."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, owners: np.ndarray, k: int) -> None:
        self.k, self.codes = k, {o: i for i, o in enumerate(dict.fromkeys(owners.tolist()))}
        who = np.array([self.codes[o] for o in owners.tolist()], np.int32)
        order = np.argsort(ids, kind="stable")
        keys = np.column_stack([vectors[order], who[order]])  # by bytes, which only tells more vectors apart
        same = np.unique(keys.view(np.dtype((np.void, keys.shape[1] * 8))).ravel(), return_inverse=True)[1]
        by = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(same[by]) > 0])
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        keep = order[np.sort(by[nth < k])]
        self.vectors, self.ids, self.who = vectors[keep], ids[keep], who[keep]
        with np.errstate(invalid="ignore", over="ignore"):
            self.squares = (self.vectors**2).sum(1)
        self.finite, self.most = bool(np.isfinite(self.squares).all()), float(np.max(self.squares, where=np.isfinite(self.squares), initial=0))

    def best(self, queries: np.ndarray, owners: np.ndarray, exclude: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, ids and squared distances: the k best of each query by distance, then id.

        The k-th least of minima over columns is no less than the k-th least number, so what is above it is left out;
        the rest, more if numbers are as good as equal, is measured again without the product's loss of digits near 0.
        """
        n, k = len(self.ids), self.k
        squares = (queries**2).sum(1)
        rough = queries @ self.vectors.T
        rough *= -2
        rough += self.squares
        rough += squares[:, None]
        if not (self.finite and np.isfinite(squares).all()):
            rough = np.nan_to_num(rough, nan=np.finfo(float).max, posinf=np.finfo(float).max, neginf=np.finfo(float).max)  # these rank last
        if exclude:
            rough[np.array([self.codes.get(o, -1) for o in owners.tolist()])[:, None] == self.who] = np.inf
        bound = np.full(len(queries), np.finfo(float).max)
        if n > k:
            high = min(64, n // k)
            least = rough[:, : n // high * high].reshape(len(queries), high, -1).min(1)
            slack = 4 * (queries.shape[1] + 2) * np.finfo(float).eps * (np.where(np.isfinite(squares), squares, 0) + self.most)
            bound = np.minimum(bound, np.partition(least, k - 1, axis=1)[:, k - 1] + slack)
        q, c = np.divmod(np.flatnonzero(rough <= bound[:, None]), n)
        exact = np.concatenate([((queries[q[i : i + 65536]] - self.vectors[c[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(q), 65536)] or [np.empty(0)])
        order = np.lexsort((self.ids[c], exact, q))
        q = q[order]
        order, q = (x[np.arange(len(q)) - np.searchsorted(q, q) < k] for x in (order, q))
        return q, self.ids[c[order]], exact[order]


def _search(k: int, exclude: bool, block: int):
    """Rows come sorted by part, the corpus before the queries: the k best of a part for each query, by products of blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, width, held, part, out, n = None, None, [], None, [], 0
        packed = lambda out: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "distance"])
        for b in batches:
            if not b.num_rows:
                continue
            place, asks = b.column("part").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip([0, *ends[:-1]], ends):
                rows = b.slice(lo, hi - lo)
                vectors, ids, owners = _matrix(rows, width), rows.column("id").to_numpy(), np.array(rows.column("entity_id").to_pylist(), object)
                width = vectors.shape[1]
                if place[lo] != at:
                    at, held, part = place[lo], [], None
                if not asks[lo]:
                    held.append((vectors, ids, owners))
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = _Part(*map(np.concatenate, zip(*held)), k), []
                for first in range(0, len(ids), block):
                    step = max(1, min(block, ROUGH // len(part.ids)))
                    for i in range(first, min(first + block, len(ids)), step):
                        own = slice(i, min(i + step, first + block))
                        q, found, distance = part.best(vectors[own], owners[own], exclude)
                        out.append((ids[own][q], found, distance))
                        n += len(q)
                        if n >= 10_000:
                            yield packed(out)
                            out, n = [], 0
        if out:
            yield packed(out)

    return run


def _met(corpus: DataFrame, queries: DataFrame, parts: int, k: int, exclude: bool, block: int) -> DataFrame:
    """(query_id, rank, vec_id, distance, similarity) of a corpus and queries (part, id, entity_id, embedding) that meet by part."""
    rows = corpus.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    dealt = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "asks")
    found = dealt.select("part", "asks", "id", "entity_id", "embedding").mapInArrow(_search(k, exclude, block), "query_id long, vec_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("similarity", X.cosine_from_squared(F.col("distance")))


def _largest(spark, n: int) -> int:
    """Vectors of a part: ``PART`` at most, fewer where all cores would not have two parts."""
    return max(1, min(PART, max(1024, n // (2 * spark.sparkContext.defaultParallelism))))


def nearest(queries: DataFrame, corpus: DataFrame, k: int = C.TOP_K, exclude_own: bool = False, block: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, distance, similarity): exact k nearest by squared distance, ties by vec_id.

    The queries are the stated set. The corpus is dealt into parts of ``PART`` vectors at most, every part gets all queries
    through a shuffle and passes them in blocks of ``block`` vectors, and a window ranks the k best of each part. So
    nothing of the queries or the corpus is on the driver, and a task holds one part and one block. Own-entity vectors
    are left out before ranking, so k are found whenever there are k.
    """
    require_positive(k=k, block=block)
    n = corpus.count()
    parts = max(1, -(-n // _largest(corpus.sparkSession, n)))
    dealt = corpus.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.col("vec_id").alias("id"), "entity_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("vec_id").alias("id"), "entity_id", "embedding")
    return _met(dealt, asked, parts, k, exclude_own, block)


def train_cells(corpus: DataFrame, cells: int = C.N_LIST, seed: int = 42) -> list[np.ndarray]:
    """Cell centres by k-means on a seeded sample: 39 vectors a cell or a tenth of all, ``TRAIN_MOST`` at most, and six roots of that more.

    The sample is drawn where the vectors are, by a bound on a hash of their ids; no task reads all of it.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = corpus.count()
    cells = X.cells_for(n, cells)
    wanted = min(n, max(39 * cells, min(n // 10, TRAIN_MOST)))
    share = (wanted + 6 * wanted**0.5) / max(1, n)  # of all hashes: at least as many vectors as wanted, but for one time in 1e9
    drawn = corpus if wanted == n or share >= 1 else corpus.where(F.xxhash64("vec_id", F.lit(seed)) < F.lit(int(share * 2**64) - 2**63))
    sample = drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return [np.asarray(c) for c in KMeans(k=cells, seed=seed).fit(sample).clusterCenters()]


def assign_cells(vectors: DataFrame, centres: list[np.ndarray], probe: int = 1) -> DataFrame:
    """Add ``cells``, the ``probe`` nearest cells of each vector; centres are sent with the task."""
    if not len(centres):
        raise ValueError("the index is not trained: it has no cells")
    matrix = np.array(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b, matrix.shape[1])
            d = (v**2).sum(1)[:, None] + (matrix**2).sum(1)[None] - 2 * v @ matrix.T
            near = (d.argmin(1)[:, None] if probe == 1 else np.argsort(d, axis=1, kind="stable")[:, :probe]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, cells array<int>")


def build_index(corpus: DataFrame, path: str, centres: list[np.ndarray], mode: str = "overwrite") -> None:
    """Write vectors by cell, a file or a few each, and the centres beside them; another call with mode append adds vectors.

    Vectors need an id and an entity, and the width of the centres; an index without centres takes none.
    """
    spark = require_columns(corpus, ["vec_id", "entity_id", "embedding"]).sparkSession
    placed = assign_cells(corpus, centres).withColumn("cell", F.element_at("cells", 1)).drop("cells")
    placed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def load_index(spark, path: str) -> tuple[DataFrame, list[np.ndarray]]:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return spark.read.parquet(f"{path}/vectors"), [np.array(r["centre"]) for r in centres]


def probe_for(queries: DataFrame, indexed: DataFrame, centres: list[np.ndarray], k: int = C.TOP_K, recall: float = 0.95, sample: int = 256) -> int:
    """The least number of cells, ``C.N_PROBE`` or more, that hold ``recall`` of the exact neighbours of a sample of the queries."""
    asked = queries.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").limit(sample).select("vec_id", "embedding", F.lit("").alias("entity_id"))
    exact = nearest(asked, indexed.withColumn("entity_id", F.lit("")), k).select("query_id", "vec_id")
    order = assign_cells(asked.select("vec_id", "embedding"), centres, len(centres)).select(F.col("vec_id").alias("query_id"), "cells")
    home = exact.join(indexed.select("vec_id", "cell"), "vec_id").join(order, "query_id")
    places = home.groupBy(F.array_position("cells", F.col("cell")).alias("place")).count().orderBy("place").toPandas()
    held = places["count"].cumsum()
    enough = places["place"][held >= recall * held.max()]
    return max(C.N_PROBE, int(enough.iloc[0])) if len(enough) else C.N_PROBE


def nearest_in_cells(queries: DataFrame, indexed: DataFrame, centres: list[np.ndarray], k: int = C.TOP_K, probe: int | None = None) -> DataFrame:
    """As :func:`nearest`, but among the vectors of each query's ``probe`` nearest cells; large cells are several parts.

    Without ``probe`` it is measured, see :func:`probe_for`.
    """
    probe = probe_for(queries, indexed, centres, k) if probe is None else probe
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # a row a cell
    largest = _largest(indexed.sparkSession, sum(sizes.values()))
    counts = [-(-sizes.get(i, 0) // largest) for i in range(len(centres))]
    first, count = (F.element_at(F.lit(x), F.col("cell") + 1) for x in (np.cumsum([0, *counts[:-1]]).tolist(), counts))
    owner = F.lit(None).cast("string").alias("entity_id")
    dealt = indexed.select((first + F.pmod(F.xxhash64("vec_id"), count)).cast("int").alias("part"), F.col("vec_id").alias("id"), owner, "embedding")
    asked = assign_cells(queries.select("vec_id", "embedding"), centres, min(probe, len(centres))).withColumn("cell", F.explode("cells")).where(count > 0)
    asked = asked.select(F.explode(F.sequence(first, first + count - 1)).alias("part"), F.col("vec_id").alias("id"), owner, "embedding")
    return _met(dealt, asked, max(1, sum(counts)), k, False, BROADCAST_QUERIES)


class SearchCache:
    """Searches kept for ``ttl`` seconds; the key is the whole request: the corpus version, the queries, k and exclusions.

    A result is a written table, so it can be read by all executors; one that has expired is searched anew.
    """

    def __init__(self, ttl: float = C.CACHE_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.clock, self.held = ttl, clock, {}

    def search(self, name: str, queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
        """The result of :func:`nearest`; ``name`` tells one version of queries and corpus from another."""
        key, now = (name, *sorted(options.items())), self.clock()
        until, table = self.held.get(key, (0.0, None))
        if table is None or now >= until:
            table = cut(nearest(queries, corpus, **options), "search")
            self.held[key] = (now + self.ttl, table)
        return table


def cached_search(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """A search written once, for as long as its table is held."""
    return cut(nearest(queries, corpus, **options), "search")
