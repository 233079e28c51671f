from itertools import product

import numpy as np

from inodeon.llm import crf


def brute(e, t):
    """Marginals and best path of one chain over all paths."""
    paths = list(product(range(e.shape[1]), repeat=len(e)))
    score = [sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths]
    w = np.exp(np.array(score) - max(score))
    w /= w.sum()
    m = np.zeros_like(e)
    for p, x in zip(paths, w):
        for i, s in enumerate(p):
            m[i, s] += x
    return m, paths[int(np.argmax(score))], max(score) + np.log(np.exp(np.array(score) - max(score)).sum())


def test_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2, 5])
    e, t = rng.normal(size=(lengths.sum(), 2)) * 2, rng.normal(size=(2, 2))
    chains = crf.Chains(lengths)
    got, _, norm = crf.marginals(e, t, chains)
    states = crf.viterbi(e, t, chains)
    at, total = 0, 0.0
    for n in lengths:
        if n:
            m, best, z = brute(e[at : at + n], t)
            assert np.allclose(got[at : at + n], m) and tuple(states[at : at + n]) == best
            total += z
        at += n
    assert np.isclose(norm, total)


def test_training_recovers_a_sticky_field():
    rng = np.random.default_rng(1)
    lengths = np.full(60, 12)
    states = np.concatenate([np.repeat(rng.integers(0, 2, 3), 4) for _ in lengths])
    x = states[:, None] * 1.5 + rng.normal(size=(len(states), 1))
    model = crf.train(x, states, lengths)
    found = crf.viterbi(model.emissions(x), model.transitions, crf.Chains(lengths))
    assert (found == states).mean() > 0.05 + ((x[:, 0] > 0.75) == states).mean()
    assert model.transitions[0, 0] > model.transitions[0, 1]
