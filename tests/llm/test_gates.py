"""The recurrent step against its formula, and logits that have to be moved."""

import warnings
from types import SimpleNamespace

import numpy as np

from skein.llm import gru_lm as G


def test_gates_take_one_exponential_and_equal_their_formula(monkeypatch):
    rng = np.random.default_rng(5)
    net = G.GRU.start(rng.integers(1, 50, 2 * G.PER_CLASS).astype(float), 30.0, 6)
    net.p["w"] *= 40  # gates of almost 0 and 1 too
    net.p["w"][3], net.p["w"][4] = 300, -300
    before = rng.integers(0, 2 * G.PER_CLASS, (12, 7))
    before[2, :3], before[5, :3] = 3, 4
    first = rng.random((12, 7)) < 0.2
    h, want, states = np.zeros((6, 7), np.float32), np.zeros((6, 7)), []
    w, u = net.p["w"].astype(float), net.p["u"].astype(float)
    for t in range(12):
        want[:, first[t]] = 0
        x, a = w[before[t]].T, u.T @ want
        z, r = (1 / (1 + np.exp(-(x[k : k + 6] + a[k : k + 6]))) for k in (0, 6))
        want = z * want + (1 - z) * np.tanh(x[12:] + r * a[12:])
        states.append(want.copy())
    seen, plain = [], np.tanh
    few = SimpleNamespace(**{k: getattr(np, k) for k in dir(np) if not k.startswith("__")})
    few.tanh = lambda x, out=None: seen.append(x.size) or plain(x, out=out)
    monkeypatch.setattr(G, "np", few)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got, _ = net.window(before, first, h, True)
    assert np.allclose(got, states, atol=2e-5) and np.array_equal(got[-1], h)
    assert sum(seen) == 12 * 6 * 7  # the candidates; gates took a slower tanh before
    assert (net.p["u"].astype(float) == u).all()


def test_large_logits_are_moved(monkeypatch):
    rng = np.random.default_rng(6)
    net = G.GRU.start(rng.integers(1, 50, 3 * G.PER_CLASS).astype(float), 30.0, 5)
    s, target = rng.uniform(-1, 1, (5, 700)).astype(np.float32), rng.integers(0, 3 * G.PER_CLASS, 700)
    for much in (1, 3000):  # logits of some hundreds, whose exponentials overflow
        net.p["o"][:, :, :-1] *= much
        logit = np.einsum("tmh,ht->tm", net.p["o"][target // G.PER_CLASS].astype(float), np.vstack([s, np.ones(700)]))
        top = logit.max(axis=1)
        want = logit[np.arange(700), target % G.PER_CLASS] - top - np.log(np.exp(logit - top[:, None]).sum(axis=1))
        for few in (0, 1 << 20):
            monkeypatch.setattr(G, "FEW", few if few == 0 else 128)
            k, order = target // G.PER_CLASS, np.argsort(target // G.PER_CLASS, kind="stable")
            logp = np.zeros(700, np.float32)
            G.level(net.p["o"], k[order], (target % G.PER_CLASS)[order], np.vstack([s, np.ones((1, 700), np.float32)]).T[order], logp, None)
            assert np.allclose(logp, want[order], rtol=1e-4, atol=1e-3)
    assert logit.max() > 100
