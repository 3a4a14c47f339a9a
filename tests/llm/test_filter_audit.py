"""op11: one file after another against all at once, smaller ids that come late, odd rows."""

import itertools
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import filter_audit as fa
from skein.llm.queries import QUERIES


def masks(rows):
    """Brute force: (part, mask, good, toxic) of each row."""
    out = []
    for i, t, p, good, toxic in rows:
        words = (t or "").split(" ") if t else []
        words = [w for w in words if w]
        m = (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in t or "") > 5 * len(t or ""))
        m += 8 * any(c in "#$%&*|" for c in t or "")
        m += 16 * any((u or "") == (t or "") and j is not None and i is not None and j < i for j, u, *_ in rows)
        out.append((p or "", m, good, toxic))
    return out


def brute(rows):
    found, out = masks(rows), {}
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            kept = list(own)
            for step, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone = [f for f in kept if f[1] & bit]
                kept = [f for f in kept if not f[1] & bit]
                fails = sum(bool(f[1] & bit) for f in own)
                lost[letter] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(kept), len(gone), fails - len(gone), sum(f[1] == bit for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(lost[order[step - 1]])
    return out


def folder(tmp_path, files):
    at = tmp_path / "documents.parquet"
    at.mkdir()
    for k, rows in enumerate(files):
        table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string()), "part": pa.array([9] * len(rows))})
        pq.write_table(table, at / f"{k}.parquet")
        os.utime(at / f"{k}.parquet", (1_700_000_000 + k,) * 2)  # files are taken in this order
    return f"file://{at}"


def labels_of(spark, rows):
    return spark.createDataFrame([(i, int(g), int(t)) for i, _, _, g, t in rows if i is not None and (g or t)] + [(None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")


def made(rng, n):
    texts = [None, "", "a", "A B # c", *(" ".join(rng.choice(["x", "Y", f"w{k}", "p|q"]) for k in range(size)) for size in (10, 60, 60, 90, 200))]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "s1", "s2", "s2", "s2"]), rng.random() < 0.3, rng.random() < 0.2) for i in range(n)]
    return rows


@pytest.mark.parametrize("ids", ["falling", "rising", "mixed"])
def test_files_one_by_one(spark, tmp_path, ids):
    rng = random.Random(ids)
    rows = made(rng, 90)
    if ids == "falling":
        rows = rows[::-1]
    elif ids == "mixed":
        rng.shuffle(rows)
        rows += [(None, rows[0][1], "s1", False, False), (None, rows[0][1], None, False, False)]  # rows without ids
        rows += [rows[3], rows[3]]  # repeated rows
    files = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    path = folder(tmp_path, files)
    ledger = fa.mask_counters(spark, path, labels_of(spark, rows), batches=99)
    assert ledger.select("batch").distinct().count() == len(files)  # a file a micro-batch
    assert (ledger.where("n < 0").count() > 0) == (ids != "rising")  # earlier counts are taken back
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in fa.order_report(ledger).collect()}
    assert got == brute(rows)


def test_all_at_once_is_the_same(spark, tmp_path):
    rows = made(random.Random(2), 60)
    path = folder(tmp_path, [rows[40:], rows[:40]])
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in fa.audit_filters(spark, path, labels_of(spark, rows)).collect()}
    assert got == brute(rows)


def test_single_file_and_empty(spark, tmp_path, sf):
    assert QUERIES["op11_filter_audit"](spark, sf).count() % 600 == 0  # a table that is one file
    path = folder(tmp_path, [[]])
    assert fa.audit_filters(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_very_long_text(spark, tmp_path):
    rows = [(1, "Word " * 400_000, "s", False, False), (0, "Word " * 400_000, "s", True, False)]
    path = folder(tmp_path, [rows[:1], rows[1:]])
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in fa.order_report(fa.mask_counters(spark, path, labels_of(spark, rows), 2)).collect()}
    assert got == brute(rows)
