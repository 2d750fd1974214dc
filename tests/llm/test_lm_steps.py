"""A gradient step against sums that are added up one by one."""

from __future__ import annotations

import numpy as np

from recscope.llm import lm_maxent as lm


def stepped(model: lm.Model, features, classes, members, squares, met) -> None:
    tables = model.class_weights, model.member_weights
    found = [(k, rows, np.exp(x), target) for k, rows, x, target, _ in model.factors(features, classes, members)]
    for k, rows, p, target in found[:2]:  # closed classes alone: each table has one factor
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(target)), target] -= 1.0
        gradient, n = np.zeros_like(tables[k]), np.zeros(len(tables[k]), np.float32)
        for own in rows:
            np.add.at(gradient, own, p)
            np.add.at(n, own, 1.0)
        squares[k] += gradient * gradient
        tables[k][:] -= lm.RATE * gradient / np.sqrt(squares[k] + 1.0)
        met[k] += n


def test_steps_are_those_of_plain_sums(monkeypatch):
    """Features of one position, of up to 32, and of most positions."""
    monkeypatch.setattr(lm, "CACHED", 100)
    draw = np.random.default_rng(4)
    words = lm.Vocabulary([b"%d" % k for k in range(lm.SHORT)], np.arange(lm.SHORT, 0, -1, dtype=float), 140_000, lm.SHORT, None)
    models = [lm.Model.new(words, np.zeros((lm.OPEN, lm.MEMBERS))) for _ in range(2)]
    state = [([np.zeros_like(m.class_weights), np.zeros_like(m.member_weights)], [np.zeros(len(m.class_weights), np.float32), np.zeros(len(m.member_weights), np.float32)]) for m in models]
    for _ in range(3):
        history = np.minimum(draw.geometric(0.02, (lm.N_FEATURES, 2_000)), 150).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        history[3] = 5
        classes, members = draw.integers(0, lm.CLOSED, 2_000), draw.integers(0, lm.MEMBERS, 2_000)
        models[0].step(history, classes, members, *state[0])
        stepped(models[1], history, classes, members, *state[1])
    assert np.array_equal(state[0][1][0], state[1][1][0]) and np.array_equal(state[0][1][1], state[1][1][1])
    assert state[0][1][0].max() >= 6_000
    for a, b in ((models[0].class_weights, models[1].class_weights), (models[0].member_weights, models[1].member_weights)):
        assert np.abs(a).max() > 0.1 and np.allclose(a, b, atol=1e-3)
