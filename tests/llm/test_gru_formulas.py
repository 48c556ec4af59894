"""The network's steps and probabilities next to the plain formulas."""

import numpy as np
import pytest
from kinepair.llm import gru


@pytest.mark.parametrize("factor", [1, 400])
def test_steps_and_probabilities_equal_the_formulas(factor):
    rng, hidden, classes = np.random.default_rng(3), 4, 4
    p = gru.initial(rng.integers(1, 50, 32).astype(float), classes, hidden)
    p = {k: (v * factor if k in "CW" else v).astype(np.float64) for k, v in p.items()}
    inputs = rng.integers(0, 33, (6, 5))
    states, kept = gru.run(p, inputs, np.zeros((5, hidden)), back=True)
    h = np.zeros((5, hidden))
    for t in range(6):
        x, u = p["E"][inputs[t]], h @ p["U"]
        r, z = (1 / (1 + np.exp(-(x + u)[:, k * hidden:(k + 1) * hidden])) for k in (0, 1))
        n = np.tanh(x[:, 2 * hidden:] + r * u[:, 2 * hidden:])
        assert np.allclose(kept[t][3], u[:, 2 * hidden:]) and np.allclose(kept[t][2], n)
        h = n + z * (h - n)
        assert np.allclose(states[t + 1], h)
    symbols = rng.integers(0, 32, 5)
    size = p["w"].shape[1]
    log = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    want = [log(h[i] @ p["C"] + p["c"])[s // size] + log(h[i] @ p["W"][s // size] + p["w"][s // size])[s % size] for i, s in enumerate(symbols)]
    assert np.allclose(gru.output(p, h, symbols)[0], want)
