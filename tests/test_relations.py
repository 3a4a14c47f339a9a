"""Relations along a catalog of foreign keys, and members of JSON cells, on odd rows."""

import pytest
from pyspark.sql import functions as F

from skein.operators import profile, relations

CATALOG = "table string, role string, place int, column string, referenced_table string, referenced_column string"


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "product": make([(1, "a"), (2, "b"), (3, None)], "id int, name string"),
        "tag": make([("x", None, "first"), ("y", "", "never"), ("z", None, None), ("w", "x2", "w")], "code string, nombre string, title string"),
        "product_tag": make([(1, "z", 1), (1, "x", 2), (1, "x", 9), (1, "y", 3), (2, "gone", 1), (2, None, 2), (None, "x", 1), (1, "w", 0)], "product int, tag string, n int"),
        "related": make([(1, 2), (1, 3), (2, 2)], "a int, b int"),
    }


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([
        ("product_tag", "junction", 1, "product", "product", "id"), ("product_tag", "junction", 2, "tag", "tag", "code"),
        ("related", "junction", 3, "a", "product", "id"), ("related", "junction", 4, "b", "product", "id"),
        ("tag", "entity", 5, "owner", "product", "id"), ("single", "junction", 6, "product", "product", "id"),
        ("missing", "junction", 7, "p", "product", "id"), ("missing", "junction", 8, "q", "nowhere", "id"),
    ], CATALOG)


def test_paths(catalog):
    found = [(p.via, p.source_column, p.target_column, p.target_table) for p in relations.relation_paths(catalog, "product")]
    assert found == [("product_tag", "product", "tag", "tag"), ("related", "a", "b", "product"), ("missing", "p", "q", "nowhere")]
    assert relations.relation_paths(catalog, "other") == []
    with pytest.raises(ValueError):
        relations.relation_paths(catalog, "product", most=2)


def test_auto_text(tables, catalog):
    text = lambda *a: {r[0]: r[1] for r in relations.auto_relation_text(tables, catalog, *a).collect()}
    assert text("product", "id", {"product_tag": ["n"]}) == {1: "x2 z first b 3", 2: "b", 3: ""}
    assert text("product", "id") == {1: "x2 first z b 3", 2: "b", 3: ""}
    assert text("tag", "code") == {"x": "a", "y": "a", "z": "a", "w": "a"}
    assert set(relations.auto_relation_text(tables, catalog.where("false"), "product", "id").collect()) == {(1, ""), (2, ""), (3, "")}


def test_labels_of_empty_tables(tables):
    none = {n: df.where("false") for n, df in tables.items()}
    call = lambda t: relations.relation_labels(t["product"], t["product_tag"], t["tag"], "id", "product", "tag", "code")
    assert call(none).count() == 0
    assert {tuple(r) for r in call({**none, "product": tables["product"]}).select("id", "search_text").collect()} == {(1, ""), (2, ""), (3, "")}


def members(spark, cells):
    long = spark.createDataFrame([("c", v) for v in cells], "column string, value string")
    return sorted((r.kind, r.value) for r in profile.atomic_members(long).collect())


def test_members(spark):
    assert members(spark, ['["a, b", ["c", [1, 1.50, 1e0, true, null, {"x": [5]}]]]']) == [("boolean", "true"), ("number", "1"), ("number", "1"), ("number", "1.5"), ("string", "a"), ("string", "b"), ("string", "c")]
    assert members(spark, [" p ,, q ", None, "", "[]", '{"a": [1]}', "null"]) == [("string", "p"), ("string", "q")]
    assert members(spark, ["[1, broken"]) == [("string", "[1"), ("string", "broken")]  # not JSON, so comma text
    assert members(spark, ['["x\\"[[,]y"]']) == [("string", ']y'), ("string", 'x"[[')]
    assert members(spark, []) == []
    assert members(spark, ["[" * 40 + "7" + "]" * 40]) == [("number", "7")]
    assert len(members(spark, ["[" + ",".join(f'"v{k}"' for k in range(200_000)) + "]"])) == 200_000


def test_profile(spark):
    cells = [("j", '["a", 1, "1"]')] * 3 + [("j", '["b"]'), ("j", None)] + [("o", '{"a": 1}'), ("t", "a,b"), ("m", "[" + ",".join(map(str, range(60))) + "]")]
    long = spark.createDataFrame(cells, "column string, value string")
    out = {r["column"]: r for r in profile.atomic_profile(long).collect()}
    assert set(out) == {"j", "m"}
    assert [(v.kind, v.value, v.n) for v in out["j"].suggested] == [("number", "1", 3), ("string", "1", 3), ("string", "a", 3), ("string", "b", 1)]
    assert (out["m"].cardinality, out["m"].truncated, out["m"].enum_candidate, len(out["m"].suggested), len(out["m"].top)) == (60, True, False, 50, 20)
    assert [r.cardinality for r in profile.atomic_profile(long, ["t"]).collect()] == [2]
    stats = {r["column"]: (r["distinct"], r.enum_candidate) for r in profile.with_atomic(profile.column_stats(long), profile.atomic_profile(long)).collect()}
    assert stats == {"j": (4, True), "m": (60, False), "o": (1, True), "t": (1, True)}
    assert profile.atomic_profile(long.where(F.lit(False))).count() == 0
