"""Gradients against differences, and the training loop's schedule, resumption and parts."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import encoder as N
from tidemark.operators import training as T

STEP = "struct<num:array<float>,cat:array<int>,ts:float>"


def batch(draw, n, kind=float):
    lengths = draw.integers(1, 6, n)
    return draw.standard_normal((n, 5, 3)).astype(kind), draw.integers(1, 5, (n, 5, 4)), draw.random((n, 5)).astype(kind), lengths


def small_weights(seed=0):
    return N.seeded_weights([5, 5, 5, 5], feature=12, hidden=8, out=6, seed=seed)


def test_training_embeds_as_the_encoder_does():
    w, (num, cat, ts, lengths) = small_weights(), batch(np.random.default_rng(1), 7, np.float32)
    assert T.embed(w, num, cat, ts, lengths)[0] == pytest.approx(N.forward(w, num, cat, ts, lengths, project=True), abs=1e-5)


def test_gradients_are_differences():
    draw = np.random.default_rng(2)
    w = {k: v.astype(float) for k, v in small_weights().items()}
    a, b = batch(draw, 4), batch(draw, 4)
    _, grads = T.gradients(w, a, b, 0.5)
    assert set(grads) == set(w)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (T.gradients(up, a, b, 0.5)[0] - T.gradients(down, a, b, 0.5)[0]) / 2e-5
        assert g[at] == pytest.approx(slope, rel=1e-3, abs=1e-7), name


def test_steps_are_clipped_and_decayed():
    w, zeros = {"a": np.array([1.0, -2.0])}, {"a": np.zeros(2)}
    first, second = dict(zeros), dict(zeros)
    T.adamw(w, {"a": np.array([30.0, 40.0])}, first, second, 1, 0.1)
    assert first["a"] == pytest.approx([0.06, 0.08], rel=1e-4)  # a gradient of norm 1
    assert w["a"] == pytest.approx([0.999 - 0.1, -1.998 - 0.1], abs=1e-5)


@pytest.fixture(scope="module")
def pairs(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(41):
        kind = int(draw.integers(1, 5))
        step = lambda: {"num": [float(x) for x in draw.standard_normal(3) * 0.1 + kind], "cat": [kind] * 4, "ts": float(draw.random())}  # noqa: B023, E731
        rows.append((i, [step() for _ in range(4)], [step() for _ in range(3)]))
    rows.append((99, [], [step()]))
    return spark.createDataFrame(rows, f"pair_id long, steps_a array<{STEP}>, steps_b array<{STEP}>").cache()


def test_training_lowers_the_loss_and_resumes(pairs):
    kept = {}
    state, losses = T.train(pairs, T.start(small_weights()), epochs=6, batch=8, rate=0.02, on_checkpoint=kept.__setitem__)
    assert len(losses) == 6 and losses[-1] < losses[0] - 0.1 and sorted(kept) == [5, 6]
    assert state["epoch"] == 6 and state["steps"] == 30  # 41 pairs are 5 batches of 8; the last pair is dropped
    resumed, more = T.train(pairs, T.load(kept[5]), epochs=6, batch=8, rate=0.02)
    assert more == pytest.approx(losses[5:], abs=1e-6)
    assert all(resumed["weights"][k] == pytest.approx(v, abs=1e-6) for k, v in state["weights"].items())
    assert (state["weights"]["table0"][0] == 0).all()


def test_parts_are_averaged(pairs):
    state, losses = T.train(pairs, T.start(small_weights()), epochs=3, batch=8, rate=0.02, parts=2)
    assert losses[-1] < losses[0] and state["steps"] <= 9
    with pytest.raises(ValueError, match="no batch"):
        T.train(pairs, T.start(small_weights()), epochs=1, batch=500)
    with pytest.raises(ValueError, match="steps_b"):
        T.train(pairs.drop("steps_b"), T.start(small_weights()), epochs=1)
