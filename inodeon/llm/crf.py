"""Linear-chain conditional random fields over real-valued features, for chains laid end to end.

Used by the page extractor and the line classifier. Chains are handled together: position t of all chains that have one is one
numpy step, so cost follows the number of rows, and memory the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """Emission weights by feature and state, transition weights, and the features' centres and scales."""

    weights: np.ndarray
    transitions: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -5, 5)
        return np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.weights


class Chains:
    """Row numbers by position, for chains of the given lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, dtype=np.int64)
        self.lengths = lengths
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        falling = -lengths[order]
        self.order = order
        self.steps = [starts[order[: int(np.searchsorted(falling, -t, "left"))]] + t for t in range(int(lengths.max(initial=0)))]


def _sum(logs: np.ndarray, axis: int) -> np.ndarray:
    top = logs.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(logs - top).sum(axis=axis))


def marginals(emissions: np.ndarray, transitions: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities by row, expected transition counts, and the summed log partition functions."""
    ahead, back = np.array(emissions), np.zeros_like(emissions)
    steps = chains.steps
    for t in range(1, len(steps)):
        at = steps[t]
        ahead[at] = emissions[at] + _sum(ahead[at - 1][:, :, None] + transitions, 1)
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        back[at - 1] = _sum(transitions + (emissions[at] + back[at])[:, None, :], 2)
    both = ahead + back
    norm = _sum(both, 1)
    pairs = np.zeros_like(transitions)
    for t in range(1, len(steps)):
        at = steps[t]
        joint = ahead[at - 1][:, :, None] + transitions + (emissions[at] + back[at])[:, None, :]
        pairs += np.exp(joint - norm[at][:, None, None]).sum(axis=0)
    return np.exp(both - norm[:, None]), pairs, float(norm[steps[0]].sum()) if steps else 0.0


def viterbi(emissions: np.ndarray, transitions: np.ndarray, chains: Chains) -> np.ndarray:
    """The most likely states by row; of equal paths the one with the lower states from the end on."""
    best = np.array(emissions)
    come = np.zeros(emissions.shape, dtype=np.int64)
    steps = chains.steps
    for t in range(1, len(steps)):
        at = steps[t]
        paths = best[at - 1][:, :, None] + transitions
        come[at] = paths.argmax(axis=1)
        best[at] += paths.max(axis=1)
    states = np.zeros(len(emissions), dtype=np.int64)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        longer = len(steps[t + 1]) if t + 1 < len(steps) else 0
        states[at[longer:]] = best[at[longer:]].argmax(axis=1)
        if longer:
            after = steps[t + 1]
            states[after - 1] = come[after, states[after]]
    return states


def train(features: np.ndarray, states: np.ndarray, lengths: np.ndarray, n_states: int = 2, rounds: int = 150, penalty: float = 1e-3, step: float = 0.1) -> Model:
    """Penalised maximum likelihood by full-batch gradient steps with adaptive moments; the same input gives the same model."""
    centre = features.mean(axis=0)
    scale = np.maximum(features.std(axis=0), 1e-3)
    chains = Chains(lengths)
    x = np.concatenate([np.clip((features - centre) / scale, -5, 5), np.ones((len(features), 1))], axis=1)
    truth = np.eye(n_states)[states]
    seen = np.zeros((n_states, n_states))
    for at in chains.steps[1:]:
        np.add.at(seen, (states[at - 1], states[at]), 1)
    weights, transitions = np.zeros((x.shape[1], n_states)), np.zeros((n_states, n_states))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, transitions)]
    rows = max(1, len(x))
    for k in range(1, rounds + 1):
        found, pairs, _ = marginals(x @ weights, transitions, chains)
        slopes = (x.T @ (truth - found) / rows - penalty * weights, (seen - pairs) / rows - penalty * transitions)
        for p, slope, (m, v) in zip((weights, transitions), slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            p += step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(weights, transitions, centre, scale)
