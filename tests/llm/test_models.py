"""The models' own arithmetic against plain loops: chains by enumeration, the convolutional network place by place."""

import itertools

import numpy as np
import pytest

from gaugeworks.llm import crf, langid, quality


def chains(seed, states=3):
    rng = np.random.default_rng(seed)
    lengths = np.array([4, 1, 0, 5, 2])
    return rng.normal(size=(lengths.sum(), states)), lengths, rng.normal(size=(states, states)), rng.normal(size=states)


def paths(emit, move, first):
    """(path, score) of all label paths of one sequence."""
    for p in itertools.product(range(emit.shape[1]), repeat=len(emit)):
        yield p, first[p[0]] + sum(emit[i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_marginals_by_enumeration(seed):
    emit, lengths, move, first = chains(seed)
    normal, state, pairs, begun = crf.marginals(emit, lengths, move, first)
    want_pairs, want_begun, at = np.zeros_like(pairs), np.zeros_like(begun), 0
    for k, n in enumerate(lengths):
        if not n:
            assert normal[k] == 0
            continue
        every = [(p, np.exp(s)) for p, s in paths(emit[at : at + n], move, first)]
        total = sum(w for _, w in every)
        assert np.isclose(normal[k], np.log(total))
        for i in range(n):
            for s in range(3):
                assert np.isclose(state[at + i, s], sum(w for p, w in every if p[i] == s) / total)
        for p, w in every:
            want_begun[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w / total
        at += n
    assert np.allclose(pairs, want_pairs) and np.allclose(begun, want_begun)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_by_enumeration(seed):
    emit, lengths, move, first = chains(seed)
    path, at = crf.viterbi(emit, lengths, move, first), 0
    for n in lengths[lengths > 0]:
        assert tuple(path[at : at + n]) == max(paths(emit[at : at + n], move, first), key=lambda x: x[1])[0]
        at += n


def test_no_sequences():
    none = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros((3, 3)), np.zeros(3)
    assert len(crf.viterbi(*none)) == 0 and crf.marginals(*none)[1].shape == (0, 3)


def test_gradient_of_the_likelihood():
    """Marginals less the truth are the gradient that training follows."""
    emit, lengths, move, first = chains(7)
    labels = np.random.default_rng(1).integers(0, 3, len(emit))

    def loss(e):
        normal, at, out = crf.marginals(e, lengths, move, first)[0], 0, 0.0
        for k, n in enumerate(lengths):
            if n:
                p = labels[at : at + n]
                out += normal[k] - (first[p[0]] + sum(e[at + i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
                at += n
        return out

    diff = crf.marginals(emit, lengths, move, first)[1] - np.eye(3)[labels]
    for i, s in ((0, 0), (5, 2), (11, 1)):
        up, down = emit.copy(), emit.copy()
        up[i, s] += 1e-5
        down[i, s] -= 1e-5
        assert np.isclose((loss(up) - loss(down)) / 2e-5, diff[i, s], atol=1e-6)


def test_document_score_is_the_weighted_mean_of_line_marginals():
    model = quality.fit(["good words here.\nand more good words."] * 5 + ["!!! $$$\n&&& ###"] * 5, [1] * 5 + [0] * 5, rounds=20)
    for text in ("one line", "good words.\n$$$ !!\n\nlast", ""):
        own, size, counts = quality.line_features([text])
        emit = model.weights[quality.neighbours(own, counts)].sum(1)
        every = [(p, np.exp(s)) for p, s in paths(emit, model.move, model.first)]
        total = sum(w for _, w in every)
        good = [sum(w for p, w in every if p[i] == 1) / total for i in range(len(emit))]
        expected = sum(g * (n + 1) for g, n in zip(good, size)) / sum(n + 1 for n in size)
        assert np.isclose(model.scores(["other\ntext", text])[1], expected)


def test_network_place_by_place():
    net = langid.Network(["a", "b", "c"], seed=3)
    text = "Größe, größer, am größten! ".encode() * 9 + b"end"
    got = net.scores([b"x", text])[1]
    total, weight = np.zeros(3), 0.0
    for at in range(0, len(text), langid.WINDOW):
        window = text[at : at + langid.WINDOW]
        x = [int(langid.CLASS[b]) for b in window.ljust(langid.WINDOW, b"\0")]
        hidden = []
        for w, table in zip(langid.WIDTHS, net.tables):
            for f in range(langid.FILTERS):
                hidden.append(max(sum(float(table[j, x[i + j], f]) for j in range(w)) for i in range(langid.WINDOW - w + 1)))
        act = [max(0.0, h + float(s)) for h, s in zip(hidden, net.shift)]
        z = [sum(a * float(net.out[i, k]) for i, a in enumerate(act)) + float(net.bias[k]) for k in range(3)]
        e = np.exp(np.array(z) - max(z))
        total += e / e.sum() * len(window)
        weight += len(window)
    assert np.allclose(got, total / weight, atol=1e-4)
