"""op13 against a version of its own in plain Python, and odd rows."""

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import fingerprints as fp
from skein.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def longs(values):
    """Spark's xxhash64 of long values: each is hashed with the hash before as its seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def ints(values):
    """The same of 32-bit values, which Spark hashes as four bytes."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v), seed)
    return signed(seed)


def fingerprint(text):
    words = [signed(xxhash.xxh64_intdigest(w, 42)) for w in text.encode().split()]
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = longs(words[i : i + 5])
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    digits = []
    for k in range(128):
        b = k if k in least else min((ints((k, b)) & -128 | b) for b in least) & 127
        digits.append(f"{least[b] & 15:x}")
    return "".join(digits)


def like(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(x == y for x, y in zip(a, b)) / 128
    return max(0.0, (same - 1 / 16) / (15 / 16))


def expected(rows):
    """rows of distinct (id, text); a null id comes last."""
    texts = [(i, t or "") for i, t, _ in rows]
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e = fingerprint(t), fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, round(like(f, e), 9), round(like(f, fingerprint(after)), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK_ROWS", 4)  # many blocks
    rng = random.Random(3)
    rows = [(None, "last of all", "x"), (5, None, None), (6, "", "a"), (7, " \t\n ", "a"), (8, "éa 漢字 \U0001f600 b c d", "a"), (9, "one two three", "a"), (10, "w " * 5000, "a")]
    rows += [(100, f"same id {k} " * 9, "s") for k in range(12)]  # ties of the id
    for i in range(200, 260):
        rows.append((i, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.choice([3, 30, 400]))), "s"))
    rows += [(i, rows[30][1], "copy") for i in range(300, 340)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(fp.fingerprint_documents(df)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one document of some words here", "a")], [(3, None, None)] * 2])
def test_few_rows(spark, rows):
    out = fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert all(r.near_next == 1.0 for r in out)


def test_repeated_rows_follow_each_other(spark):
    rows = [(2, "a b c d e f g", "x")] * 3 + [(1, "p q r s t u v w", "x")]
    out = sorted((r.doc_id, float(r.near_next > 0.5)) for r in fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 0.0), (2, 0.0), (2, 1.0), (2, 1.0)]


def test_likeness_is_near_the_true_one(spark):
    """Mean error of 128 bins: a bias well below one bin, a spread as the theory has it."""
    rng, rows, true = random.Random(1), [], {}
    for i in range(0, 300, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        keep = rng.choice([30, 150, 270])
        other = base[:keep] + [f"v{rng.randrange(10**6)}" for _ in range(300 - keep)]
        a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (base, other))
        true[i + 1] = len(a & b) / len(a | b)
        rows += [(i + 1, " ".join(base), ""), (i, " ".join(other), "")]
    out = {r.doc_id: r.near_next for r in fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    errors = [out[i] - t for i, t in true.items()]
    assert abs(sum(errors) / len(errors)) < 0.015
    assert max(map(abs, errors)) < 0.2


def test_no_python_in_the_plan(spark, sf):
    df = QUERIES["op13_fingerprints"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.where(F.col("near_edited").isNull() | ~F.col("near_edited").between(0, 1)).count() == 0


def test_columns_of_other_names(spark):
    rows = [(1, "a b c", "x", 1), (2, "d e f", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, __b int")
    assert fp.fingerprint_documents(df).count() == 2
