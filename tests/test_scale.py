"""Work that grows with distinct texts, filters and blocks, exact quantiles, and no broadcast of large sides."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from skein.operators import branches as B
from skein.operators import filters, search
from skein.plans.queries import QUERIES
from skein.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_is_not_broadcast(spark):
    q = spark.createDataFrame([(1, "red bolt, Brand"), (2, "red bolt, Brand"), (3, "nut")], "query_id long, text string")
    s = spark.createDataFrame([("bolt", "B-1"), ("ed b", "x")], "term string, synonym string")
    parts = B.branches(q, s)
    assert "Broadcast" not in plan(parts)
    assert {(r.query_id, r.text) for r in parts.where("kind = 'synonym'").collect()} == {(k, t) for k in (1, 2) for t in ("B-1", "x")}
    hits = spark.createDataFrame([(1, 5, "bolt")], "query_id long, id long, text string")
    assert "Broadcast" not in plan(B.distinctive_coverage(parts, hits)) and "Broadcast" not in plan(B.select_branches(parts))


def test_shared_texts_are_searched_once(spark, monkeypatch):
    asked = []
    match = B.lexical_match
    monkeypatch.setattr(B, "lexical_match", lambda index, queries: asked.append(queries.count()) or match(index, queries))
    parts = spark.createDataFrame([(k, t, w) for k in range(20) for t, w in (("red bolt", 1.0), ("nut", 1.5))] + [(99, None, 1.0)], "query_id long, text string, weight double")
    index = search.token_index(spark.createDataFrame([(1, "red bolt"), (2, "bolt nut"), (3, "nut")], "id long, name string"), "id", {"name": 1.0})
    got = {(r.query_id, r.id, r.place) for r in B.lexical_multi(parts, index).collect()}
    assert asked == [2] and got == {(k, i, p) for k in range(20) for i, p in ((2, 1), (3, 2), (1, 3))}


def test_exact_quantiles(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    value = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 100).alias("value")
    rows = spark.range(0, 40_000, 1, 8).select((F.lit(at) + F.make_interval(secs=F.col("id") % 3000)).alias("ts"), F.when(F.col("id") % 11 > 0, value).alias("value"), (F.col("id") % 7 == 0).alias("bad"))
    late = spark.createDataFrame([(at + datetime.timedelta(hours=9), 1.0, False), (at + datetime.timedelta(hours=12), None, True)], rows.schema)
    known = np.sort([r.value for r in rows.where("value is not null").collect()])
    want = tuple(float(known[int(np.ceil(p * len(known) - 1e-9)) - 1]) for p in (0.5, 0.95))
    whole = streams.rolling_metrics(rows.unionByName(late), "ts", "value", F.col("bad"), "1 hour", "1 hour")
    got = {r.n: r for r in whole.collect() if r.n > 1}[40_000]
    assert (got.p50, got.p95) == want and got.errors == 5715 and abs(got.mean_value - known.mean()) < 1e-5
    assert {(r.p50, r.p95) for r in whole.collect() if r.n == 1} == {(1.0, 1.0), (None, None)}
    rows.write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.tumbling_metrics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "value", F.col("bad"), "1 hour")
    streams.log_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.n == 40_000]
    assert [(r.p50, r.p95, r.errors) for r in got] == [(*want, 5715)]


def test_distances(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [3.0, 3.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    out = search.distances(v.withColumnRenamed("id", "query_id").where("query_id <> 2"), v, block=2)
    got = {(r.query_id, r.id): r.distance for r in out.collect()}
    have = {k: np.array(e) for k, e in rows if e and any(e)}
    want = {(a, b): round(1 - float(have[a] @ have[b]) / np.linalg.norm(have[a]) / np.linalg.norm(have[b]), 6) + 0.0 if a in have and b in have else None for a in (1, 3, 4, 5) for b in (1, 2, 3, 4, 5)}
    assert got == want and out.count() == 20
    assert "FlatMapCoGroups" in plan(QUERIES["vec_1_distance"](spark, "/root/testdata/sf0.001"))


def test_scope_by_a_function(spark):
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "id long, embedding array<double>")
    q = v.where("id = 0").withColumnRenamed("id", "query_id")
    got = search.knn_scoped(q, v, lambda hits: hits.where("id % 2 = 0"), 2, probe=6)
    assert sorted((r.id, r.place) for r in got.collect()) == [(0, 1), (2, 2)]


def test_equal_filters_are_matched_once(spark, monkeypatch):
    records = spark.createDataFrame([(k, k % 2, {"n": str(k)}, {"tags": ["a"] if k % 3 else ["b"]}) for k in range(12)], "id long, side int, texts map<string,string>, lists map<string,array<string>>")
    queries = spark.createDataFrame([(q, q % 2) for q in range(8)] + [(50, None)], "query_id long, side int")
    wanted = spark.createDataFrame([(q, "n", "gte", ["6"]) for q in range(4)] + [(q, "tags", "eq", ["a"]) for q in (2, 3, 4)] + [(5, "none", "neq", ["x"])], "query_id long, field string, op string, values array<string>")
    pairs = queries.join(records, "side").select("query_id", "id")
    want = sorted(tuple(r) for r in filters.match_filters(pairs, records, wanted).collect())
    got = filters.match_scoped(queries, records, wanted, ["side"])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_second_run_joins_its_filters(spark):
    text = plan(QUERIES["rank_7_second_run"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"\[query_id#\d+L?, id#\d+L?\][^\n]*LeftAnti", text)


def test_attributes_are_worked_out_once(spark, monkeypatch):
    """The parts of the map stand once in its expression, whatever the number of steps over them."""
    from skein.operators import mapping

    monkeypatch.setattr(mapping, "attribute_key", lambda c: F.upper(c))
    rows = "array<struct<namespace: string, key: string, value: string>>"
    df = spark.createDataFrame([(1, [("o", "1")], "a:2,A=3", [("n", "a", "4"), ("m", "a", "5"), ("n", "b", "6")], None)], f"id long, options array<struct<name: string, value: string>>, tags string, product {rows}, variant {rows}")
    made = df.select(mapping.attribute_map(F.col("options"), F.col("tags"), F.col("product"), F.col("variant")).alias("m"))
    assert made.first().m == {"O": "1", "A": "3", "N.A": "4", "M.A": "5", "N.B": "6", "B": "6"}
    assert made._jdf.queryExecution().analyzed().toString().count("upper(") == 6


def test_mentions_are_not_broadcast(spark):
    from skein.operators import mentions

    q = spark.createDataFrame([(1, "red bolt"), (2, "nut")], "query_id long, text string")
    v = spark.createDataFrame([("name", "red", "red"), ("name", "nut", "nut")], "field string, value string, phrase string")
    found = mentions.implicit_links(q, v, [])
    assert "Broadcast" not in plan(found) and sorted((r.query_id, r.value) for r in found.collect()) == [(1, "red"), (2, "nut")]


def test_words_become_stems_a_row_each(spark):
    """A batch of Arrow holds words, not the words of ten thousand texts."""
    from skein.operators.lexical import postings

    r = spark.createDataFrame([(1, "red bolts", "de nut"), (2, "", "bolts of bolts"), (3, None, None)], "id long, a string, d string")
    index = postings(r, "id", {"a": "A", "d": "D"}, "a")
    text = plan(index)
    assert text.index("ArrowEvalPython") < text.index("Generate explode")
    assert {(x.token, x.id): [tuple(h) for h in x.hits] for x in index.collect()} == {("red", 1): [(1, 1.0)], ("bolts", 1): [(2, 1.0)], ("nut", 1): [(4, 0.1)], ("bolts", 2): [(1, 0.1), (3, 0.1)], ("of", 2): [(2, 0.1)]}


def test_keys_of_a_stream_share_calls(spark, tmp_path):
    """Nulls and keys beyond the whole numbers of doubles stay apart; state goes on over micro-batches."""
    from skein.streaming import state

    at, big = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), 2**53
    rows = [((big, big + 1, None, 5)[n % 4], None if n == 7 else n, at + datetime.timedelta(seconds=n)) for n in range(24)]
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, "k long, id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = state.rate_limit(stream, ["k"], "id", "ts", 2, 100)
    assert "_bucket" in out._jdf.queryExecution().analyzed().toString()
    streams.log_stream(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.k, r.id, r.place, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(k, i, n // 4 + 1, n < 8) for n, (k, i, _) in enumerate(rows)}
