"""op12 against brute force over all periods, and odd rows."""

import hashlib
import random
import zlib

import pytest

from skein.llm import periodic_runs as pr
from skein.llm.queries import QUERIES


def brute(w, least=24, power=3):
    """All stretches of each period from the smallest on; a stretch is taken once."""
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, power * q):
                out.setdefault((start, length), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng, kinds, size):
    w = []
    while len(w) < size:
        kind = rng.randrange(4)
        if kind == 0:
            w += [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(30))]
        elif kind == 1:  # a run, with a rest of its period
            u = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 40))]
            w += u * rng.randrange(1, 9) + u[: rng.randrange(len(u) + 1)]
        elif kind == 2 and w:
            at = rng.randrange(len(w))
            w += w[at : at + rng.randrange(60)]
        else:
            w += [b"x"] * rng.randrange(40)
    return w


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
def test_runs_of_batches(kinds):
    rng = random.Random(kinds)
    for _ in range(60):
        texts = [made(rng, kinds, rng.choice([0, 30, 200, 500])) for _ in range(4)]
        texts.append(list(texts[0]))  # a copy in the same batch shares nothing with it
        assert pr.find_runs(texts) == [brute(w) for w in texts]


def test_other_limits():
    rng = random.Random(9)
    for least, power in ((6, 2), (10, 3), (40, 5)):
        for _ in range(40):
            w = made(rng, 3, 150)
            assert pr.find_runs([w], least, power) == [brute(w, least, power)], (least, power)


def test_long_texts_of_each_kind():
    """Work near linear in the words: one word, a short period, a passage between other words."""
    n = 60_000
    assert pr.find_runs([[b"a"] * n]) == [[(0, n, 1)]]
    assert pr.find_runs([[b"%d" % (i % 7) for i in range(n)]]) == [[(0, n, 7)]]
    lines = [x for i in range(3000) for x in (b"l%d" % i, *(b"p%d" % k for k in range(20)))]
    assert pr.find_runs([lines]) == [[]]


def expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def test_query_of_small_texts(spark):
    rng = random.Random(4)
    rows = [(i, b" ".join(made(rng, 4, rng.choice([0, 40, 150]))).decode(), 1) for i in range(300)]
    rows += [(None, "a " * 30, 1), (400, None, 1), (401, "", 1), (402, " \n ", 1), (5, rows[5][1], 1), (403, "ä ö " * 20, 1), (404, "tie " * 24 + "x " + "tie " * 24, 1)]
    out = pr.run_digests(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)


def test_query_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(out) == len(docs) and any(r[1] for r in out.values())
    for d in docs:
        if len(d.text or "") < 8000:
            assert out[d.doc_id] == expected(d.doc_id, d.text)


def test_empty_table(spark):
    assert pr.run_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
