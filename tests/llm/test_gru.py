"""The language model: gradients, learning, and what its scores depend on."""

import numpy as np

from skein.llm import gru_lm as G


def small_net(classes=2, hidden=5):
    rng = np.random.default_rng(3)
    net = G.GRU.start(rng.integers(1, 50, classes * G.PER_CLASS).astype(float), 30.0, hidden)
    net.p = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(float) for k, x in net.p.items()}
    return net, rng


def test_gradients_are_those_of_the_loss():
    net, rng = small_net()
    docs = [rng.integers(0, 2 * G.PER_CLASS + 1, n).astype(np.int16) for n in (9, 4, 3, 1)]
    lanes = G.Lanes(docs, 0)
    lanes = G.Lanes(docs, 0, 3) if len(lanes.sizes) > 1 else lanes
    before, first, target, real, _ = next(lanes.windows(32))
    h = lambda: np.zeros((5, before.shape[1]))
    loss = lambda: -net.gradients(before, first, target, real, h())[3].sum()
    grad, used, rows, _ = net.gradients(before, first, target, real, h())
    whole = np.zeros_like(net.p["w"])
    whole[used] = rows
    for name, g in {**grad, "w": whole}.items():
        x = net.p[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-9), 6):
            old = x[k]
            x[k] = old + 1e-5
            up = loss()
            x[k] = old - 1e-5
            down = loss()
            x[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-4 * max(1, abs(g.reshape(-1)[k])), name


def test_probabilities_of_all_words_sum_to_one():
    net, rng = small_net()
    words = 2 * G.PER_CLASS + 1
    s = np.repeat(rng.standard_normal((5, 1)), words, axis=1)
    assert abs(np.exp(net.outputs(s, np.arange(words))[0]).sum() - 1) < 1e-9


def test_lanes_hold_every_token_once_and_a_long_text_costs_no_more():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 9, n).astype(np.int16) for n in (200_000, 1, 7000, *[900] * 300)]
    lanes = G.Lanes(docs, 0)
    assert len(lanes.target) == sum(map(len, docs))
    got = [[] for _ in docs]
    for _, first, target, real, doc in lanes.windows(4096):
        for lane in range(target.shape[1]):
            for t in np.flatnonzero(real[:, lane])[:: 1 if lane > 2 else 500]:
                got[doc[t, lane]].append(int(target[t, lane]))
    assert got[1] == docs[1].tolist() and got[5] == docs[5].tolist()


def test_state_is_carried_over_windows():
    net, rng = small_net()
    doc = [rng.integers(0, 100, 70).astype(np.int16)]
    sums = []
    for size in (70, 13):
        h, total = np.zeros((5, 1)), 0.0
        for before, first, target, real, _ in G.Lanes(doc, 0).windows(size):
            states, _ = net.window(before, first, h, False)
            total += net.outputs(net.at(states, real), target[real])[0].sum()
        sums.append(total)
    assert abs(sums[0] - sums[1]) < 1e-9


def test_training_helps_and_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda rows: sum(r.score for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    trained = G.score_documents(docs, rounds=4).collect()
    plain = G.score_documents(docs, rounds=0).collect()
    assert held(trained) > held(plain) + 0.02
    again = {r.doc_id: r.score for r in G.score_documents(docs.repartition(5), rounds=4).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * abs(r.score) for r in trained)


def test_empty_table(spark):
    assert G.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_and_row_sums_equal_a_plain_softmax(monkeypatch):
    net, rng = small_net(3)
    s, target = rng.standard_normal((5, 900)), rng.integers(0, 3 * G.PER_CLASS + 1, 900)
    target[:400] = 70  # one class of more tokens than a block, beside small ones
    rows, groups, per = np.vstack([s, np.ones(900)]).T, *G.GRU.grouped(3)
    k = target // G.PER_CLASS
    group = np.where(k < 3, k // per, groups)
    known = k < 3
    inside = [(net.p["c"], np.zeros_like(k), group, known | True), (net.p["g"], group, k % per, known), (net.p["o"], k, target % G.PER_CLASS, known)]
    want, by_s, by_w = np.zeros(900), np.zeros_like(s.T), {}
    for name, (w, sets, member, there) in zip("cgo", inside):
        by_w[name] = np.zeros_like(w)
        for t in np.flatnonzero(there):
            logit = w[sets[t]] @ rows[t]
            p = np.exp(logit - logit.max())
            p /= p.sum()
            want[t] += np.log(p[member[t]])
            p[member[t]] -= 1
            by_w[name][sets[t]] += p[:, None] * rows[t]
            by_s[t] += p @ w[sets[t]][:, :-1]
    for block, few in ((64, 0), (64, 8), (1024, 128)):
        monkeypatch.setattr(G, "BLOCK", block)
        monkeypatch.setattr(G, "FEW", few)
        grad = {}
        logp, ds = net.outputs(s, target, grad)
        assert np.allclose(logp, want) and np.allclose(ds, by_s.T)
        assert all(np.allclose(grad[x][..., :-1], by_w[x][..., :-1]) and np.allclose(grad[x][..., -1], by_w[x][..., -1]) for x in "cgo")
    ids = np.concatenate([np.full(700, 4), rng.integers(0, 60, 200), [90]])
    values = rng.standard_normal((len(ids), 6))
    used, sums = G.sums_by(ids, values)
    assert sorted(used) == sorted(set(ids.tolist()))
    assert all(np.allclose(x, values[ids == i].sum(axis=0)) for i, x in zip(used, sums))


_FAULTS = """
import resource, sys
import numpy as np
from skein.llm import common, gru_lm as G
getattr(common, "keep_memory", lambda: None)()
rng = np.random.default_rng(1)
top = G.MOST_WORDS
net, cache = G.GRU.start(1e6 / np.arange(1, top + 1), 1e5), {}
lanes = G.Lanes([np.minimum(rng.zipf(1.2, 500), top).astype(np.int16) for _ in range(1280)], 0)
h, faults = np.zeros((G.HIDDEN, len(lanes.sizes)), np.float32), []
for before, first, target, real, _ in lanes.windows():
    h = np.ascontiguousarray(h[:, : before.shape[1]])
    net.learn(before, first, target, real, h, cache, 0.05, G.WINDOW * len(lanes.sizes))
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print((faults[20] - faults[10]) // 10)
"""


def test_a_training_step_takes_no_new_memory():
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", _FAULTS], capture_output=True, text=True, check=True, cwd=Path(G.__file__).parents[2])
    assert int(out.stdout) < 500  # pages a window; several thousand where its arrays come from the system each time


def test_a_shard_somewhat_above_its_size_is_trained_on_as_a_whole(spark, monkeypatch, tmp_path):
    import uuid

    class Seen(G.Lanes):
        def __init__(self, docs, end_id):
            super().__init__(docs, end_id)
            (tmp_path / uuid.uuid4().hex).write_text(str(len(self.target)))

    for name, value in {"Lanes": Seen, "SHARD": 4000, "CHUNK": 4000, "HOLD": 5000}.items():
        monkeypatch.setattr(G, name, value, raising=name != "HOLD")
    rows = [(k, np.full(100, k % 60, np.int16).tobytes(), False) for k in range(44)]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary, held_out boolean")
    G.trained(coded, G.GRU.start(np.ones(G.PER_CLASS), 1.0).flat(), 1, 0, 4400, 1, 0.05)
    assert [p.read_text() for p in tmp_path.iterdir()] == ["4400"]
