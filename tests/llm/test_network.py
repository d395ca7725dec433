"""The byte network against a direct convolution and its gradients against differences of the loss."""

import numpy as np
import pytest

from corpusloom.llm import language_id as L


def windows(rng, n):
    """Windows of full length, padded ones, one of a single byte class and one of padding alone."""
    codes = rng.integers(0, L.CLASSES, (n, L.WINDOW)).astype(np.uint8)
    codes[1, 5:], codes[2], codes[3] = 0, 7, 0
    return codes


def direct(p, codes):
    """Probabilities by the definition: every filter at every place, the largest response, softmax."""
    out = []
    for row in codes:
        x, pooled = p["vectors"][row], []
        for w in L.WIDTHS:
            places = [x[at : at + w].reshape(-1) @ p[f"filter{w}"] + p[f"bias{w}"] for at in range(L.WINDOW - w + 1)]
            pooled.append(np.maximum(np.max(places, axis=0), 0))
        logits = np.concatenate(pooled) @ p["out"] + p["out_bias"]
        e = np.exp(logits - logits.max())
        out.append(e / e.sum())
    return np.array(out)


def network(seed):
    net = L.Network(["a", "b", "c"], seed)
    rng = np.random.default_rng(seed)
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in net.p.items()}
    net.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    return net, rng


@pytest.mark.parametrize("seed", [1, 2])
def test_forward(seed):
    net, rng = network(seed)
    codes = windows(rng, 9)
    assert L.window_probabilities(net.tables(), codes) == pytest.approx(direct(net.p, codes), abs=1e-6)


def test_forward_in_slices():
    """More windows than are looked up at once."""
    net, rng = network(3)
    codes = rng.integers(0, L.CLASSES, (1030, L.WINDOW)).astype(np.uint8)
    assert L.window_probabilities(net.tables(), codes)[[0, 511, 512, 1029]] == pytest.approx(direct(net.p, codes[[0, 511, 512, 1029]]), abs=1e-6)


def test_gradients():
    net, rng = network(4)
    codes, labels = windows(rng, 5), np.array([0, 1, 2, 0, 1])
    start = {k: v.copy() for k, v in net.p.items()}
    net._step(codes, labels)
    grad = {k: m / 0.1 for k, (m, _) in net.moments.items()}  # the first moment after one step is a tenth of the gradient

    def loss(p):
        return -np.log(direct(p, codes)[np.arange(5), labels]).mean()

    for k, v in start.items():
        entries = [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)]
        entries += [(0, 0), (7, 1)] if k == "vectors" else []  # padding and the class that a whole window holds
        for at in entries:
            moved = []
            for step in (1e-6, -1e-6):
                p = {**start, k: v.copy()}
                p[k][at] += step
                moved.append(loss(p))
            assert grad[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-7, rel=1e-4)
    before = loss(start)
    for _ in range(20):
        net._step(codes, labels)
    assert loss(net.p) < before


def test_windows():
    texts = [b"", b"a", b"A" * L.WINDOW, bytes(range(256)) * 2]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    owner, codes = L.windows_of(data, offsets)
    assert owner.tolist() == [1, 2, 3, 3, 3, 3]
    for k, text in enumerate(texts):
        mine = codes[owner == k].reshape(-1)
        assert mine[: len(text)].tolist() == [L._CLASS[b] for b in text] and not mine[len(text) :].any()
