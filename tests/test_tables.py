"""Search, filters, vectors and streams over small tables with the hard cases in them."""

import datetime

from skein.functions.text import normalize_text
from skein.operators import filters, profile, raw, search
from skein.operators.branches import query_terms
from skein.streaming import state


def test_search_terms(spark):
    records = spark.createDataFrame([(1, "red steel bolt", "x"), (2, "steel red bolt", None), (3, None, None), (4, "bolt, red; steel", "bolt"), (5, "a b", "c d")], "id long, name string, kind string")
    asked = spark.createDataFrame([(1, '"red steel"'), (2, "bolt -red"), (3, "nut or bolt"), (4, "-red"), (5, ""), (6, '"b c"'), (7, "b c"), (8, "missing bolt")], "query_id long, text string")
    got = {tuple(r) for r in search.lexical_search(records, "id", {"name": 1.0, "kind": 0.5}, query_terms(asked)).collect()}
    assert got == {(1, 1, 2.0), (1, 4, 2.0), (3, 1, 1.0), (3, 2, 1.0), (3, 4, 1.0), (7, 5, 1.5)}


def test_knn_ties_nulls_blocks(spark):
    rows = [(k, [1.0, float(k % 3)], "m") for k in range(40)] + [(98, None, "m"), (99, [1.0, 0.0], "other")]
    v = spark.createDataFrame(rows, "id long, embedding array<double>, model string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [1.0, 2.0], "m"), (3, None, "m"), (4, [1.0, 0.0], "none")], "query_id long, embedding array<double>, model string")
    near = search.knn(q, v, 3, block=7, by=["model"])
    assert sorted((r.query_id, r.place, r.id) for r in near.collect()) == [(1, 1, 0), (1, 2, 3), (1, 3, 6), (2, 1, 2), (2, 2, 5), (2, 3, 8)]
    allowed = spark.createDataFrame([(1, 3), (1, 39), (1, 1)], "query_id long, id long")
    assert [(r.id, r.place) for r in search.knn_scoped(q, v, allowed, 2, probe=14, by=["model"]).orderBy("place").collect()] == [(3, 1), (39, 2)]
    assert search.knn(q, v.limit(0), 3).count() == 0


def test_filters_over_tables(spark):
    records = spark.createDataFrame(
        [(1, {"tags": "a , b", "n": "5"}, {}), (2, {"n": "x"}, {"tags": ["a", "c"]}), (3, {"tags": "Ab"}, {"n": ["5"]})],
        "id long, texts map<string,string>, lists map<string,array<string>>",
    )
    cases = [("tags", "eq", ["a"], {1, 2}), ("tags", "neq", ["a"], {3}), ("n", "gte", ["5"], {1}), ("tags", "in", ["b", "c"], {1, 2}), ("tags", "containsAll", ["a", "c"], {2}),
             ("tags", "contains", ["B"], {1, 3}), ("tags", "containsAny", ["c", "AB"], {2, 3}), ("none", "neq", ["a"], set()), ("tags", "what", ["a"], set())]
    pairs = spark.createDataFrame([(q, i) for q in range(len(cases) + 1) for i in (1, 2, 3)], "query_id long, id long")
    wanted = spark.createDataFrame([(q, f, o, v) for q, (f, o, v, _) in enumerate(cases)], "query_id long, field string, op string, values array<string>")
    got = {tuple(r) for r in filters.match_filters(pairs, records, wanted).collect()}
    assert got == {(q, i) for q, (_, _, _, ids) in enumerate(cases) for i in ids} | {(len(cases), i) for i in (1, 2, 3)}


def test_suggest(spark):
    words = ["Álamo", "Palabra", "al", "Balsa", ""]
    v = spark.createDataFrame([("f", w) for w in words], "field string, value string")
    v = v.withColumn("norm", normalize_text(v.value))
    q = spark.createDataFrame([(k, "f", t) for k, t in enumerate(["ala", "al", "alabr", "", "zzz"])], "query_id long, field string, norm string")
    got = {}
    for r in profile.suggest_values(v, q).collect():
        got.setdefault(r.query_id, set()).add(r.value)
    assert got == {0: {"Álamo", "Palabra"}, 1: {"Álamo", "Palabra", "al", "Balsa"}, 2: {"Palabra"}, 3: set(words)}


def test_delete_parents(spark):
    rows = [("p1", "{}"), ("v1", '{"productId":"p1"}'), ("v2", '{"productId":"p2"}'), (None, None), ("x", "no json")]
    stored = spark.createDataFrame(rows, "id string, payload string")
    left = raw.delete_parents(stored, spark.createDataFrame([("p1",), ("gone",)], "id string"), "id", "payload")
    assert left.columns == stored.columns and sorted(str(r.id) for r in left.collect()) == ["None", "v2", "x"]


def _stream(spark, folder, batches, schema, frame):
    """Runs frame(stream) over a file a batch, in the order of the batches."""
    out = []
    for k, rows in enumerate(batches):  # a run for each batch: state comes from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder + "/in")
        source = spark.readStream.schema(schema).json(folder + "/in")
        frame(source).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return out


def _at(s):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)


def test_deliveries_over_batches(spark, tmp_path):
    schema = "provider string, hook string, id long, at timestamp, outcome string, ended timestamp"
    first = [("s", "a", 1, _at(0), "failed", _at(10)), ("s", "b", 2, _at(0), "completed", _at(10)), ("s", "c", 3, _at(0), None, None), ("s", None, 4, _at(0), "completed", _at(1))]
    then = [("s", "a", 5, _at(60), "completed", _at(70)), ("s", "b", 6, _at(60), "completed", _at(70)), ("s", "c", 7, _at(60), None, None), ("s", "c", 8, _at(901), "failed", _at(902)), ("s", None, 9, _at(60), None, None)]
    got = _stream(spark, str(tmp_path), [first, then], schema, lambda s: state.deliveries(s, "provider", "hook", "id", "at", "outcome", "ended"))
    assert {r[2]: r[5] for r in got} == {1: "failed", 2: "completed", 3: "processing", 4: "completed", 5: "completed", 6: "ignored", 7: "ignored", 8: "failed", 9: "processing"}


def test_rate_limit_over_batches(spark, tmp_path):
    first, then = [(("k", n, _at(s))) for n, s in ((1, 0), (2, 0), (3, 59))], [("k", n, _at(s)) for n, s in ((4, 59), (5, 60), (6, 119), (7, 121), (8, 300))]
    got = _stream(spark, str(tmp_path), [first, then], "k string, id long, at timestamp", lambda s: state.rate_limit(s, ["k"], "id", "at", 2, 60))
    assert {r[1]: r[5] for r in got} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True, 8: True}
