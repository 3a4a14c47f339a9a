"""Findings of round 3 on the corpus operators."""

import random
from types import SimpleNamespace

import numpy as np

from skein.llm import gru_lm as G
from skein.llm import token_counts as T


def test_a_part_is_encoded_once_and_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    sent = []

    def encode_batch(parts, add_special_tokens):
        sent.extend(parts)
        return [SimpleNamespace(size=len(p)) for p in parts]

    measured = T._remembered(encode_batch, lambda e: e.size)
    long = "x" * 100
    assert measured([["a", " b", " b"], ["a", long]]) == [[1, 2, 2], [1, 100]] and sorted(sent) == sorted(["a", " b", long])
    assert measured([["a", long, " b"]]) == [[1, 100, 2]] and sent[3:] == [long]  # long parts aren't kept
    assert measured([[f"{k}" for k in range(10)]]) and len(sent) == 14
    assert measured([["a"]]) == [[1]] and sent[14:] == ["a"]  # beyond KEPT all is dropped


def test_parts_are_encoded_as_in_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    counts, ends = T._loader(path)
    rng = random.Random(4)
    some = [*"ab'st 1.\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0᠎ ​   　﻿é漢😀́\0", "<|endoftext|>", "'ll", "  "]
    texts = ["", " ", *("".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(3000))]
    want = [whole.encode(t, add_special_tokens=False) for t in texts]
    assert counts(texts) == [len(w.ids) for w in want]
    assert all(ends(t).tolist() == [e for _, e in w.offsets] for t, w in zip(texts, want))
    assert all("".join(T._PARTS.findall(t)) == t for t in texts)


def test_every_word_of_a_small_corpus_has_an_output_of_its_own(spark, monkeypatch):
    seen = {}

    def trained(coded, start, classes, end_id, tokens, rounds, rate):
        seen.update(classes=classes, own=sum(n for r in coded.select("n_unknown").collect() for n in r), end=end_id)
        return start

    monkeypatch.setattr(G, "trained", trained)
    rows = [(k, " ".join(f"w{(k * 7 + j) % 900}" for j in range(30))) for k in range(600)]
    G.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == {"classes": 15, "own": 0, "end": 0}  # 900 words and the end; nothing is scored as the unknown word
    assert G.MOST_WORDS == 32_704


def test_three_levels_sum_to_one_and_sets_may_be_worked_on_in_any_way(monkeypatch):
    rng = np.random.default_rng(3)
    classes, hidden = 7, 5  # three groups of three classes, two places empty
    net = G.GRU.start(rng.integers(1, 50, classes * G.PER_CLASS).astype(float), 30.0, hidden)
    net.p = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(float) for k, x in net.p.items()}
    words = classes * G.PER_CLASS + 1
    for size in (1, 1000):  # logits that have to be moved before they are raised
        s = np.repeat(rng.standard_normal((hidden, 1)), words, axis=1) * size
        assert abs(np.exp(net.outputs(s, np.arange(words))[0]).sum() - 1) < 1e-9
    s, target = rng.standard_normal((hidden, 700)), rng.integers(0, words, 700)
    target[:300] = 3
    got = []
    for few in (0, 4, 128):
        monkeypatch.setattr(G, "FEW", few)
        grad = {}
        logp, ds = net.outputs(s, target, grad)
        got.append([logp, ds, *(grad[k] for k in sorted(grad))])
    for other in got[1:]:
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got[0], other))
    assert np.isfinite(got[0][0]).all() and np.isfinite(got[0][1]).all()
