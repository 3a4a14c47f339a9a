"""Keyed stores, the vector cache and suggested filters on odd rows."""

import pytest
from pyspark.sql import functions as F

from skein.operators import query_cache, suggested
from skein.sources.store import read_store, versions, write_keyed

ROW = "k int, v string"


def test_keyed_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda *r: spark.createDataFrame(r, ROW)
    assert versions(spark, path) == [] and read_store(spark, path, ROW).count() == 0
    assert write_keyed(make((1, "a"), (2, "b")), path, ["k"]) == 1
    old = read_store(spark, path, ROW)
    for bad in (make((1, "a"), (1, "b")), make((None, "a"))):
        with pytest.raises(ValueError):
            write_keyed(bad, path, ["k"])
    assert versions(spark, path) == [1]  # a refused version is never seen
    assert write_keyed(old.unionByName(make((3, "c"))), path, ["k"]) == 2  # reads the store that it writes
    assert write_keyed(make((1, "x"), (1, "y")), path, ["k", "v"]) == 3
    assert old.count() == 2 and read_store(spark, path, ROW, 2).count() == 3
    assert write_keyed(make((1, "x")).where("false"), path, ["k"]) == 4 and read_store(spark, path, ROW).count() == 0
    with pytest.raises(ValueError):
        read_store(spark, path, ROW, 9)


def test_query_key(spark):
    rows = spark.createDataFrame([(" Ámbar\t de  MAR ",), ("ambar de mar",)], "q string")
    assert rows.select(query_cache.query_key(F.lit("m"), F.lit(3), F.col("q"))).distinct().count() == 1
    assert rows.select(F.explode(F.array(*[query_cache.query_key(F.lit(m), F.lit(d), F.col("q")) for m, d in (("m", 3), ("m", 4), ("n", 3))]))).distinct().count() == 3


def test_cache(spark):
    now = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    new = lambda *r: spark.createDataFrame(r, "key string, embedding array<double>")
    asked = lambda *r: spark.createDataFrame([(k,) for k in r], "key string")
    state = lambda c: {r.key: (r.hit_count, r.embedding, r.created_at.day, r.last_used.day, r.expires_at.day) for r in c.collect()}
    empty = spark.createDataFrame([], query_cache.SCHEMA)
    one = query_cache.store(empty, new(("a", [1.0]), ("b", [1.0]), ("b", [2.0]), (None, [3.0])), now(1))
    assert state(one) == {"a": (1, [1.0], 1, 1, 8), "b": (2, [2.0], 1, 1, 8)}
    two = query_cache.record_hits(one, asked("a", "a", "a", "z", None), now(5))
    assert state(two) == {"a": (4, [1.0], 1, 5, 8), "b": (2, [2.0], 1, 1, 8)}
    assert state(query_cache.record_hits(two, asked("a", "b"), now(8))) == state(two)  # expired from the very moment on
    assert {(r.key, r.embedding is None) for r in query_cache.found(asked("a", "z"), two, now(8)).collect()} == {("a", True), ("z", True)}
    three = query_cache.store(two, new(("a", [9.0])), now(9))
    assert state(three) == {"a": (5, [9.0], 1, 9, 16), "b": (2, [2.0], 1, 1, 8)}


FIELDS = [("e", "size", "number", ""), ("e", "tone", "string", "also: colour"), ("e", "on", "boolean", ""), ("e", "note", "string", "")]
VALUES = [("e", "tone", "red", 1), ("e", "tone", "blue", 2), ("e", "tone", None, 3)]


def suggest(spark, answers, used=(), texts=None):
    """Filters and warnings of text k, for which the model answers answers[k]."""
    def model(prompts):
        return [answers[int(p.rpartition("Text: ")[2])] for p in prompts]

    fields = suggested.field_lists(spark.createDataFrame(FIELDS, "entity string, field string, kind string, description string"), spark.createDataFrame(VALUES, "entity string, field string, value string, rank int"))
    rows = spark.createDataFrame(texts or [(k, "e", str(k)) for k in range(len(answers))], "query_id int, entity string, text string")
    out = suggested.model_filters(rows, spark.createDataFrame(list(used), "query_id int, field string"), fields, model)
    return {r.query_id: (sorted((f.field, f.value) for f in r.filters), r.warnings) for r in out.collect()}


def test_suggested(spark):
    bad = ["invalid filters"]
    assert suggest(spark, [
        '{"filters": {"size": 1.5, "tone": "blue", "on": false, "note": "a } b"}}', 'x {"filters": {"tone": "green", "size": 1}} y', '{"filters": {"size": "1"}}', '{"filters": {"on": null}}',
        '{"filters": [1]}', '{"filters": {}}', '{"filters": null}', "[]", "```\n{\"filters\": {\"on\": true}}\n``` {", '{"filters": {"who": {"a": 1}, "on": true}}', "{", None,
    ]) == {
        0: ([("note", "a } b"), ("on", "false"), ("size", "1.5"), ("tone", "blue")], []), 1: ([], bad), 2: ([], bad), 3: ([], bad),
        4: ([], bad), 5: ([], []), 6: ([], []), 7: ([], []), 8: ([("on", "true")], []), 9: ([("on", "true")], ["unknown field who"]), 10: ([], ["no answer"]), 11: ([], ["no answer"]),
    }


def test_suggested_fields_left(spark):
    answer = ['{"filters": {"size": 2, "on": true}}'] * 9
    used = [(0, "size"), (1, "size"), (1, "tone"), (1, "on"), (1, "note")]
    texts = [(0, "e", "0"), (1, "e", "1"), (2, "e", " "), (3, "e", None), (4, "other", "4"), (5, "e", "5"), (6, "e", "5"), (7, "e", "99")]
    assert suggest(spark, answer, used, texts) == {0: ([("on", "true")], ["unknown field size"]), 5: ([("on", "true"), ("size", "2")], []), 6: ([("on", "true"), ("size", "2")], []), 7: ([], ["no answer"])}
