"""Contrastive training of the sequence encoder, data-parallel over Spark partitions.

An epoch is one pass over all pairs: every part starts from the same weights and moments, takes its batches in order with
AdamW, gradients clipped to a norm of 1, and sends what it has; the mean weighted by batches starts the next epoch. With
one part this is the plain loop. The rate follows a cosine over the epochs. Batches all have one size, so what is left of
a part at its end is dropped, as the loss needs. The driver holds one model; Python does the gradients, by hand, in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.guards import require_columns, require_positive
from tidemark.operators import encoder as N

# The optimizer's usual settings, and how often weights are kept.
BETAS, EPSILON, DECAY, CLIP, KEEP_EVERY = (0.9, 0.999), 1e-8, 0.01, 1.0, 5

Arrays = dict[str, np.ndarray]


def _normed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    return (x - x.mean(-1, keepdims=True)) / spread, spread


def _normed_back(d: np.ndarray, y: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return (d - d.mean(-1, keepdims=True) - y * (d * y).mean(-1, keepdims=True)) / spread


def _rows(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _linear_back(grads: Arrays, name: str, d: np.ndarray, x: np.ndarray, w: Arrays) -> np.ndarray:
    grads[f"{name}_w"] = grads.get(f"{name}_w", 0) + _rows(d).T @ _rows(x)
    grads[f"{name}_b"] = grads.get(f"{name}_b", 0) + _rows(d).sum(0)
    return d @ w[f"{name}_w"]


def _recur(x: np.ndarray, w: Arrays, layer: int, inside: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    size = w[f"re{layer}_w"].shape[1]
    given, state, kept = x @ w[f"in{layer}_w"].T + w[f"in{layer}_b"], np.zeros((len(x), size), x.dtype), []
    out = np.zeros((*x.shape[:2], size), x.dtype)
    for t in range(x.shape[1]):
        fed = state @ w[f"re{layer}_w"].T + w[f"re{layer}_b"]
        gates = N._sigmoid(given[:, t, : 2 * size] + fed[:, : 2 * size])
        r, z = gates[:, :size], gates[:, size:]
        new = np.tanh(given[:, t, 2 * size :] + r * fed[:, 2 * size :])
        kept.append((state, r, z, new, fed[:, 2 * size :]))
        state = out[:, t] = np.where(inside[:, t, None], (1 - z) * new + z * state, state)
    return out, kept


def _recur_back(d_out: np.ndarray, x: np.ndarray, kept: list[tuple], w: Arrays, layer: int, inside: np.ndarray, grads: Arrays) -> np.ndarray:
    d_given, d_state = np.zeros((*x.shape[:2], w[f"in{layer}_w"].shape[0]), x.dtype), np.zeros_like(d_out[:, 0])
    for t in reversed(range(x.shape[1])):
        before, r, z, new, fed = kept[t]
        d = d_state + d_out[:, t]
        here = np.where(inside[:, t, None], d, 0)
        d_new = here * (1 - z) * (1 - new**2)
        d_r, d_z = d_new * fed * r * (1 - r), here * (before - new) * z * (1 - z)
        d_given[:, t] = np.concatenate([d_r, d_z, d_new], axis=1)
        d_state = d - here + here * z + _linear_back(grads, f"re{layer}", np.concatenate([d_r, d_z, d_new * r], axis=1), before, w)
    return _linear_back(grads, f"in{layer}", d_given, x, w)


def embed(w: Arrays, num: np.ndarray, cat: np.ndarray, ts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], Arrays]]:
    """Projected unit vectors, and the function from their gradient to that of each weight."""
    inside = np.arange(num.shape[1])[None] < lengths[:, None]
    tables = [w[f"table{i}"][cat[..., i]] for i in range(cat.shape[-1])]
    numbers, number_spread = _normed(num @ w["num_w"].T + w["num_b"])
    joined = np.concatenate([*tables, numbers], axis=-1)
    fused, fused_spread = _normed(joined @ w["fuse_w"].T + w["fuse_b"])
    phase = ts[..., None] * w["t_w"] + w["t_b"]
    layers = [np.concatenate([fused, phase[..., :1], np.sin(phase[..., 1:])], axis=-1)]
    steps = []
    for layer in range(C.GRU_LAYERS):
        out, kept = _recur(layers[-1], w, layer, inside)
        layers.append(out)
        steps.append(kept)
    states = layers[-1]
    u = np.tanh(states @ w["att_w"].T + w["att_b"])
    score = np.where(inside, u @ w["query"], -np.inf)
    share = np.exp(score - score.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", share, states)
    first = pooled @ w["p1_w"].T + w["p1_b"]
    out = np.maximum(first, 0) @ w["p2_w"].T + w["p2_b"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    unit = out / size

    def back(d: np.ndarray) -> Arrays:
        grads: Arrays = {}
        d = _linear_back(grads, "p2", (d - unit * (unit * d).sum(1, keepdims=True)) / size, np.maximum(first, 0), w)
        d = _linear_back(grads, "p1", d * (first > 0), pooled, w)
        d_share = np.einsum("bh,bth->bt", d, states)
        d_score = share * (d_share - (share * d_share).sum(1, keepdims=True))
        grads["query"] = np.einsum("bt,bth->h", d_score, u)
        d_states = share[..., None] * d[:, None] + _linear_back(grads, "att", d_score[..., None] * w["query"] * (1 - u**2), states, w)
        for layer in reversed(range(C.GRU_LAYERS)):
            d_states = _recur_back(d_states, layers[layer], steps[layer], w, layer, inside, grads)
        width = fused.shape[-1]
        d_phase = np.concatenate([d_states[..., width : width + 1], d_states[..., width + 1 :] * np.cos(phase[..., 1:])], axis=-1)
        grads["t_w"], grads["t_b"] = (d_phase * ts[..., None]).sum((0, 1)), d_phase.sum((0, 1))
        d_joined = _linear_back(grads, "fuse", _normed_back(d_states[..., :width], fused, fused_spread), joined, w)
        lo = 0
        for i, table in enumerate(tables):
            grads[f"table{i}"] = np.zeros_like(w[f"table{i}"])
            np.add.at(grads[f"table{i}"], cat[..., i], d_joined[..., lo : lo + table.shape[-1]])
            grads[f"table{i}"][0] = 0  # padding
            lo += table.shape[-1]
        _linear_back(grads, "num", _normed_back(d_joined[..., lo:], numbers, number_spread), num, w)
        return grads

    return unit, back


def contrast(a: np.ndarray, b: np.ndarray, temperature: float = C.TEMPERATURE) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss of matched unit vectors and its gradient for both sides."""
    both, n = np.concatenate([a, b]), len(a)
    like = both @ both.T / temperature
    np.fill_diagonal(like, -np.inf)
    like -= like.max(axis=1, keepdims=True)
    part = np.exp(like)
    total = part.sum(axis=1, keepdims=True)
    match = (np.arange(2 * n) + n) % (2 * n)
    loss = float(np.mean(np.log(total[:, 0]) - like[np.arange(2 * n), match]))
    part /= total
    part[np.arange(2 * n), match] -= 1
    d = (part + part.T) @ both / (2 * n * temperature)
    return loss, d[:n], d[n:]


def gradients(w: Arrays, a: tuple, b: tuple, temperature: float = C.TEMPERATURE) -> tuple[float, Arrays]:
    """Loss and gradients of a batch of (num, cat, ts, lengths) of either view."""
    (za, back_a), (zb, back_b) = embed(w, *a), embed(w, *b)
    loss, da, db = contrast(za, zb, temperature)
    ga, gb = back_a(da), back_b(db)
    return loss, {k: ga[k] + gb[k] for k in ga}


def adamw(w: Arrays, grads: Arrays, first: Arrays, second: Arrays, step: int, rate: float) -> None:
    """One step in place, the gradients clipped together."""
    norm = math.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grads.values()))
    scale = min(1.0, CLIP / (norm + 1e-6))
    for k, g in grads.items():
        first[k] = BETAS[0] * first[k] + (1 - BETAS[0]) * scale * g
        second[k] = BETAS[1] * second[k] + (1 - BETAS[1]) * (scale * g) ** 2
        at = np.sqrt(second[k] / (1 - BETAS[1] ** step)) + EPSILON
        w[k] = (w[k] * (1 - rate * DECAY) - rate * first[k] / (1 - BETAS[0] ** step) / at).astype(w[k].dtype)


def start(weights: Arrays) -> dict[str, Arrays | int]:
    """The state before the first epoch."""
    zeros = lambda: {k: np.zeros_like(v) for k, v in weights.items()}
    return {"weights": dict(weights), "first": zeros(), "second": zeros(), "epoch": 0, "steps": 0}


def save(state: dict) -> bytes:
    flat = {f"{part}/{k}": v for part in ("weights", "first", "second") for k, v in state[part].items()}
    return N.save_weights(flat | {"epoch": np.array(state["epoch"]), "steps": np.array(state["steps"])})


def load(data: bytes) -> dict:
    flat = N.load_weights(data)
    parts = {p: {k.split("/", 1)[1]: v for k, v in flat.items() if k.startswith(f"{p}/")} for p in ("weights", "first", "second")}
    return parts | {"epoch": int(flat["epoch"]), "steps": int(flat["steps"])}


def _epoch(sent, batch: int, rate: float, temperature: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = sent.value
        w, first, second = (dict(state[k]) for k in ("weights", "first", "second"))
        waiting, n, total = [], 0, 0.0
        for f in frames:
            waiting += list(f[["steps_a", "steps_b"]].itertuples(index=False, name=None))
            while len(waiting) >= batch:
                now, waiting = waiting[:batch], waiting[batch:]
                sides = []
                for side in zip(*now, strict=True):
                    lengths = np.array([len(s) for s in side])
                    sides.append((*N.collate(list(side), lengths), lengths))
                n += 1
                loss, grads = gradients(w, *sides, temperature)
                adamw(w, grads, first, second, state["steps"] + n, rate)
                total += loss
        if n:
            for part, held in (("weights", w), ("first", first), ("second", second)):
                for k, v in held.items():
                    yield pd.DataFrame([{"part": part, "name": k, "n": n, "loss": total, "v": v.astype(np.float32).tobytes()}])

    return run


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    n = group["n"].to_numpy(float)
    mean = sum(np.frombuffer(v, np.float32).astype(float) * k for v, k in zip(group["v"], n, strict=True)) / n.sum()
    row = group.iloc[0]
    return pd.DataFrame([{"part": row["part"], "name": row["name"], "n": int(n.max()), "batches": int(n.sum()), "loss": float(group["loss"].sum()), "v": mean.astype(np.float32).tobytes()}])


def train(
    pairs: DataFrame, state: dict, epochs: int, batch: int = 64, rate: float = 1e-3, temperature: float = C.TEMPERATURE, parts: int = 1,
    on_checkpoint: Callable[[int, bytes], None] = lambda epoch, data: None,
) -> tuple[dict, list[float]]:
    """Train up to ``epochs`` on (pair_id, steps_a, steps_b); returns the state and the mean loss of each epoch run.

    ``state`` is :func:`start`'s, or a loaded checkpoint's, which goes on after its epoch. Checkpoints are handed over
    every ``KEEP_EVERY`` epochs and at the end. Pairs with an empty side are left out; too few pairs for a batch are an error.
    """
    require_positive(batch=batch, epochs=epochs, temperature=temperature, parts=parts)
    require_columns(pairs, ["pair_id", "steps_a", "steps_b"])
    rows = pairs.where((F.size("steps_a") > 0) & (F.size("steps_b") > 0)).repartition(parts, "pair_id").sortWithinPartitions("pair_id").select("steps_a", "steps_b")
    context, losses = pairs.sparkSession.sparkContext, []
    for epoch in range(state["epoch"] + 1, epochs + 1):
        sent = context.broadcast({k: state[k] for k in ("weights", "first", "second", "steps")})  # one model
        now = rate * 0.5 * (1 + math.cos(math.pi * (epoch - 1) / epochs))
        found = rows.mapInPandas(_epoch(sent, batch, now, temperature), "part string, name string, n int, loss double, v binary")
        found = found.groupBy("part", "name").applyInPandas(_mean, "part string, name string, n int, batches int, loss double, v binary").toPandas()
        sent.unpersist()
        if found.empty:
            raise ValueError(f"epoch {epoch} has no batch of {batch} pairs")
        held = {(r.part, r.name): np.frombuffer(r.v, np.float32) for r in found.itertuples(index=False)}
        new = {p: {k: held[p, k].reshape(v.shape) for k, v in state[p].items()} for p in ("weights", "first", "second")}
        state = new | {"epoch": epoch, "steps": state["steps"] + int(found["n"].iloc[0])}
        losses.append(float(found["loss"].iloc[0]) / int(found["batches"].iloc[0]))
        if epoch % KEEP_EVERY == 0 or epoch == epochs:
            on_checkpoint(epoch, save(state))
    return state, losses
