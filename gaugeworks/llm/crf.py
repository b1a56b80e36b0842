"""Linear-chain conditional random fields in numpy, over batches of sequences."""

from __future__ import annotations

import numpy as np


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)


def steps(lengths: np.ndarray):
    """Sequences longest first, and for each place t how many of them reach it. Empty sequences take no part."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    longest = int(lengths[order[0]]) if len(order) else 0
    alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left") if longest else np.zeros(0, int)
    return order, alive


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray):
    """Forward-backward. emit: places x states of all sequences, one after another.

    Returns the log-likelihood's normalisers, the state marginals, and the summed transition and first-state marginals.
    """
    order, alive = steps(lengths)
    start = starts_of(lengths)[order]
    ahead = np.zeros_like(emit)
    for t, n in enumerate(alive):
        at = start[:n] + t
        ahead[at] = emit[at] + (first if t == 0 else logsumexp(ahead[at - 1][:, :, None] + move, 1))
    back = np.zeros_like(emit)
    pairs, total = np.zeros_like(move), np.zeros(len(order))
    size = lengths[order]
    total = logsumexp(ahead[start + size - 1], 1) if len(order) else total
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        at = start[:n] + t
        rest = emit[at + 1] + back[at + 1]
        joint = ahead[at][:, :, None] + move + rest[:, None, :] - total[:n, None, None]
        pairs += np.exp(joint).sum(0)
        back[at] = logsumexp(move + rest[:, None, :], 2)
    normal = np.zeros(len(lengths))
    normal[order] = total
    state = np.exp(ahead + back - np.repeat(normal, lengths)[:, None])
    return normal, state, pairs, state[start].sum(0)


def viterbi(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    order, alive = steps(lengths)
    start = starts_of(lengths)[order]
    best, via = np.zeros_like(emit), np.zeros(emit.shape, np.int16)
    for t, n in enumerate(alive):
        at = start[:n] + t
        if t == 0:
            best[at] = emit[at] + first
        else:
            score = best[at - 1][:, :, None] + move
            via[at] = score.argmax(1)
            best[at] = emit[at] + score.max(1)
    path = np.zeros(len(emit), np.int16)
    size = lengths[order]
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        last = size[:n] == t + 1
        nxt = np.where(last, at, np.minimum(at + 1, len(emit) - 1))
        path[at] = np.where(last, best[at].argmax(1), via[nxt, path[nxt]])
    return path


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def train(emission, gradient, weights: np.ndarray, labels: np.ndarray, lengths: np.ndarray, states: int, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, forbidden: np.ndarray | None = None, weight: np.ndarray | None = None):
    """Maximum likelihood by Adam. emission(weights): places x states; gradient(g): that of the weights.

    weight: of each place's sequence, in what emissions learn; moves and first states count each place once. Returns weights, moves and first-state scores.
    """
    move, first = np.zeros((states, states)), np.zeros(states)
    barred = np.zeros((states, states), bool) if forbidden is None else forbidden
    start = starts_of(lengths)
    inner = np.ones(len(labels), bool)
    inner[start[lengths > 0]] = False
    wanted = np.zeros((states, states))
    np.add.at(wanted, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    opened = np.bincount(labels[start[lengths > 0]], minlength=states)
    truth, n = np.eye(states)[labels], max(1, len(labels))
    adam = Adam([weights, move, first], rate)
    for _ in range(rounds):
        _, state, pairs, begun = marginals(emission(weights), lengths, np.where(barred, -1e4, move), first)
        diff = (state - truth) * (1 if weight is None else weight[:, None])
        adam.step([gradient(diff) / n + decay * weights, (pairs - wanted) / n + decay * move, (begun - opened) / n + decay * first])
    return weights, np.where(barred, -1e4, move), first
