"""The sequence encoder's forward pass in numpy, run on Arrow batches, and the contrastive loss.

Layers: one embedding table a categorical column and a normalised projection of the numbers, fused; a learned Time2Vec
beside it; two recurrent layers with gates (reset, update, new); additive attention over the steps that are there; an
optional projection head; unit length. Weights are given, from a file or from a seed.
"""

from __future__ import annotations

import io
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import exprs as X
from tidemark.functions.guards import require_columns, require_positive


def seeded_weights(vocabularies: list[int], numbers: int = 3, feature: int = C.FEATURE_DIM, hidden: int = C.GRU_HIDDEN, out: int = C.EMBED_DIM, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the right shapes, drawn from a seed; row 0 of a table is padding and stays 0."""
    draw = np.random.default_rng(seed)
    matrix = lambda *s: (draw.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
    w: dict[str, np.ndarray] = {}
    widths = [X.embed_dim(v) for v in vocabularies]
    for i, (v, d) in enumerate(zip(vocabularies, widths, strict=True)):
        w[f"table{i}"] = matrix(v, d)
        w[f"table{i}"][0] = 0
    w |= {"num_w": matrix(32, numbers), "num_b": np.zeros(32, np.float32), "fuse_w": matrix(feature, sum(widths) + 32), "fuse_b": np.zeros(feature, np.float32)}
    w |= {"t_w": (draw.standard_normal(C.TIME2VEC) * 0.01).astype(np.float32), "t_b": np.zeros(C.TIME2VEC, np.float32)}
    for layer in range(C.GRU_LAYERS):
        size = feature + C.TIME2VEC if layer == 0 else hidden
        w |= {f"in{layer}_w": matrix(3 * hidden, size), f"in{layer}_b": np.zeros(3 * hidden, np.float32), f"re{layer}_w": matrix(3 * hidden, hidden), f"re{layer}_b": np.zeros(3 * hidden, np.float32)}
    w |= {"att_w": matrix(hidden, hidden), "att_b": np.zeros(hidden, np.float32), "query": matrix(1, hidden)[0]}
    return w | {"p1_w": matrix(hidden, hidden), "p1_b": np.zeros(hidden, np.float32), "p2_w": matrix(out, hidden), "p2_b": np.zeros(out, np.float32)}


def save_weights(weights: dict[str, np.ndarray]) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    return buffer.getvalue()


def load_weights(data: bytes, strict: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights from a file's bytes; with ``strict`` names and shapes must agree."""
    with np.load(io.BytesIO(data)) as f:
        weights = {k: f[k] for k in f.files}
    if strict is not None and {k: v.shape for k, v in weights.items()} != {k: v.shape for k, v in strict.items()}:
        raise ValueError("weights do not fit the model")
    return weights


def from_entry(entry: dict, meta: dict) -> dict[str, np.ndarray]:
    """The weights a registry entry names, checked against the vocabularies of its feature metadata."""
    sizes = [len(meta["vocab_maps"][c]) + 1 for c in C.CATEGORICAL]
    with open(entry["weights_path"], "rb") as f:
        return load_weights(f.read(), strict=seeded_weights(sizes))


def time2vec_parameters(weights: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """The learned time encoding, for a registry entry."""
    return {"weights": [float(x) for x in weights["t_w"]], "phases": [float(x) for x in weights["t_b"]]}


def _layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _recur(x: np.ndarray, w: dict[str, np.ndarray], layer: int, inside: np.ndarray) -> np.ndarray:
    hidden = w[f"re{layer}_w"].shape[1]
    given = x @ w[f"in{layer}_w"].T + w[f"in{layer}_b"]
    state, out = np.zeros((len(x), hidden), np.float32), np.zeros((*x.shape[:2], hidden), np.float32)
    for t in range(x.shape[1]):
        from_state = state @ w[f"re{layer}_w"].T + w[f"re{layer}_b"]
        r, z = np.split(_sigmoid(given[:, t, : 2 * hidden] + from_state[:, : 2 * hidden]), 2, axis=1)
        new = np.tanh(given[:, t, 2 * hidden :] + r * from_state[:, 2 * hidden :])
        state = np.where(inside[:, t, None], (1 - z) * new + z * state, state)
        out[:, t] = state
    return out


def attention_pool(states: np.ndarray, inside: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """States weighted by a softmax over the steps that are there; zeros if none is."""
    score = np.where(inside, np.tanh(states @ w["att_w"].T + w["att_b"]) @ w["query"], -np.inf)
    top = score.max(axis=1, keepdims=True)
    weight = np.exp(score - np.where(np.isfinite(top), top, 0))
    total = weight.sum(axis=1, keepdims=True)
    weight = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
    return np.einsum("bt,bth->bh", weight, states)


def forward(w: dict[str, np.ndarray], num: np.ndarray, cat: np.ndarray, ts: np.ndarray, lengths: np.ndarray, project: bool = False) -> np.ndarray:
    """Unit vectors of padded sequences: num (B, L, 3), cat (B, L, 4), ts (B, L), lengths (B)."""
    inside = np.arange(num.shape[1])[None] < lengths[:, None]
    parts = [w[f"table{i}"][cat[..., i]] for i in range(cat.shape[-1])]
    parts.append(_layer_norm(num @ w["num_w"].T + w["num_b"]))
    fused = _layer_norm(np.concatenate(parts, axis=-1) @ w["fuse_w"].T + w["fuse_b"])
    phase = ts[..., None] * w["t_w"] + w["t_b"]
    x = np.concatenate([fused, phase[..., :1], np.sin(phase[..., 1:])], axis=-1).astype(np.float32)
    for layer in range(C.GRU_LAYERS):
        x = _recur(x, w, layer, inside)
    out = attention_pool(x, inside, w)
    if project:
        out = np.maximum(out @ w["p1_w"].T + w["p1_b"], 0) @ w["p2_w"].T + w["p2_b"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def collate(steps: list, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded arrays of a batch of step lists."""
    if not len(lengths):
        raise ValueError("an empty batch cannot be collated")
    top = int(lengths.max())
    num, cat, ts = np.zeros((len(steps), top, 3), np.float32), np.zeros((len(steps), top, 4), np.int64), np.zeros((len(steps), top), np.float32)
    for i, (s, n) in enumerate(zip(steps, lengths, strict=True)):
        for t in range(int(n)):
            num[i, t], cat[i, t], ts[i, t] = s[t]["num"], s[t]["cat"], s[t]["ts"]
    return num, cat, ts


def encode(sequences: DataFrame, weights: dict[str, np.ndarray], keys: list[str], chunk: int = 512, project: bool = False) -> DataFrame:
    """(keys, embedding) of sequences (keys, steps, length), ``chunk`` at a time."""
    sent = sequences.sparkSession.sparkContext.broadcast(weights)  # one model
    schema = ", ".join(f"`{k}` {sequences.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), chunk):
                part = f.iloc[lo : lo + chunk]
                lengths = part["length"].to_numpy()
                out = part[keys].copy()
                out["embedding"] = list(forward(sent.value, *collate(part["steps"].tolist(), lengths), lengths, project))
                yield out

    return sequences.select(*keys, "steps", "length").mapInPandas(run, schema)


WARM_UPS, ONLINE_CHUNK = 3, 64


def encode_one(weights: dict[str, np.ndarray], steps: list[dict], project: bool = False) -> np.ndarray:
    """The vector of a single sequence, given without a batch dimension."""
    lengths = np.array([len(steps)])
    return forward(weights, *collate([steps], lengths), lengths, project)[0]


def encode_online(sequences: DataFrame, weights: dict[str, np.ndarray], keys: list[str], chunk: int = ONLINE_CHUNK, project: bool = False) -> DataFrame:
    """As :func:`encode`, with ``latency_ms``, the time of the chunk that a row was in, and ``chunk_rows``.

    Each worker first runs ``WARM_UPS`` sequences of zeros, whose time is not kept.
    """
    require_positive(chunk=chunk)
    sent = sequences.sparkSession.sparkContext.broadcast(weights)  # one model
    schema = ", ".join(f"`{k}` {sequences.schema[k].dataType.simpleString()}" for k in keys) + ", embedding array<float>, latency_ms double, chunk_rows int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in range(WARM_UPS):
            forward(sent.value, np.zeros((1, 8, 3), np.float32), np.zeros((1, 8, 4), np.int64), np.zeros((1, 8), np.float32), np.array([8]))
        for f in frames:
            for lo in range(0, len(f), chunk):
                part = f.iloc[lo : lo + chunk]
                lengths = part["length"].to_numpy()
                inputs = collate(part["steps"].tolist(), lengths)
                began = time.perf_counter()
                vectors = forward(sent.value, *inputs, lengths, project)
                took = 1000 * (time.perf_counter() - began)
                yield part[keys].assign(embedding=list(vectors), latency_ms=took, chunk_rows=len(part))

    return require_columns(sequences, [*keys, "steps", "length"]).select(*keys, "steps", "length").mapInPandas(run, schema)


def ntxent(pairs: DataFrame, temperature: float = C.TEMPERATURE, batch: str | None = None) -> DataFrame:
    """``loss``: symmetric contrastive loss of a batch (i, a, b) of matched unit vectors; with ``batch``, one row a batch.

    Every vector's similarities to the others of its batch are needed, so a batch of the size that training takes is
    joined to itself, on its number; there are as many rows as batches times their size squared.
    """
    require_positive(temperature=temperature)
    batched = pairs.select((F.col(batch) if batch else F.lit(0)).alias("batch"), "i", "a", "b")
    views = F.array(F.struct(F.lit(0).alias("view"), F.col("a").alias("e")), F.struct(F.lit(1).alias("view"), F.col("b").alias("e")))
    rows = batched.select("batch", "i", F.explode(views).alias("x")).select("batch", "i", "x.*")
    other = rows.select("batch", F.col("i").alias("j"), F.col("view").alias("w"), F.col("e").alias("o"))
    sims = rows.join(other, "batch").where("i <> j OR view <> w").withColumn("s", X.dot(F.col("e"), F.col("o")) / temperature)
    each = sims.groupBy("batch", "i", "view").agg(F.log(F.sum(F.exp(F.col("s") - 1 / temperature))).alias("l"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("p"))
    loss = F.avg(F.col("l") + 1 / temperature - F.col("p")).alias("loss")
    return each.groupBy(F.col("batch").alias(batch)).agg(loss) if batch else each.agg(loss)


def latency_percentiles(samples: DataFrame, value: str = "latency_ms", order: str = "seq", cap: int = 10_000) -> DataFrame:
    """(n, p50, p95, p99) of the last ``cap`` samples, by nearest rank with ties to even."""
    last = samples.orderBy(F.desc(order)).limit(cap)
    held = last.agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("a")).withColumn("n", F.size("a"))
    at = lambda p: F.get("a", F.bround(F.lit(p) / 100 * (F.col("n") - 1)).cast("int"))
    return held.select("n", *[F.coalesce(at(p), F.lit(0.0)).alias(f"p{p}") for p in (50, 95, 99)])
