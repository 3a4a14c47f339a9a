"""Null, empty and repeated inputs of the operators on texts and relevance."""

from skein.operators import branches as B
from skein.operators import checks, evals
from skein.operators import relevance as R


def test_branches_of_nothing(spark):
    q = spark.createDataFrame([(1, None), (2, ""), (3, "  ,; ")], "query_id long, text string")
    s = spark.createDataFrame([("a", "b"), (None, None)], "term string, synonym string")
    got = B.branches(q, s).collect()
    assert {r.query_id for r in got} <= {3}
    assert B.query_terms(q).where("query_id < 3").count() == 0


def test_branches_of_a_text(spark):
    q = spark.createDataFrame([(1, "tela Aida o lino, aceite 19l")], "query_id long, text string")
    s = spark.createDataFrame([("aceite", "A-19"), ("aceite", "20 lts"), ("aceit", "Z")], "term string, synonym string")
    got = {(r.text, r.kind) for r in B.branches(q, s).collect()}
    assert ("tela Aida o lino, aceite 19l", "full") in got and ("A-19", "synonym") in got and ("Z", "synonym") in got
    assert ("Aida", "distinctive") in got and ("tela Aida", "distinctive") in got and ("tela", "distinctive") not in got
    chosen = [r.text for r in B.select_branches(B.branches(q, s)).collect()]
    assert len(chosen) == 6 and {"A-19", "20 lts", "Z"} <= set(chosen)


def test_identifier(spark):
    rows = [("SKU: ab-12.", "ab-12"), ("X9-7", "X9-7"), ("año 2024", None), ("", None), (None, None), ("p/n 55-A;", "55-A"), ("ref a1", None)]
    got = spark.createDataFrame(rows, "t string, want string").select(B.explicit_identifier(B.F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_relevance_without_concepts(spark):
    hits = spark.createDataFrame([(1, 7, 0.0, None, False), (1, 8, 0.0, 0.5, True)], "query_id long, id long, score double, distance double, identifier boolean")
    records = spark.createDataFrame([(7, None, "x", None, "y"), (8, "p", None, None, None)], "id long, a string, b string, c string, d string")
    none = spark.createDataFrame([], "query_id long, alternatives array<string>")
    got = {r.id: r for r in R.relevance(hits, none, records).collect()}
    assert got[7].coverage == 1.0 and got[8].relevance == 1.0 and not got[7].conflict


def test_quantities(spark):
    rows = [("aceite 19lts", "bidon 20 litros", True), ("19 l", "19,0 lt y 4 l", False), ("motor 4t", "2 tiempos", True), ("4t", "nada", False), (None, "4t", False)]
    got = spark.createDataFrame(rows, "q string, h string, want boolean").select(R.F.coalesce(R.quantity_conflict(R.F.col("q"), R.F.col("h")), R.F.lit(False)).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_empty_checks(spark):
    checks_ = spark.createDataFrame([], "case_id long, passed boolean, reason string")
    assert evals.verdict(checks_).count() == 0
    filters = spark.createDataFrame([(1, "f", "eq", None), (1, None, "eq", "x")], "query_id long, field string, op string, value string")
    fields = spark.createDataFrame([("f", "string", False, True, True, False)], "field string, kind string, sensitive boolean, visible boolean, filterable boolean, fixed boolean")
    got = sorted(r.reason for r in checks.filter_violations(filters, fields).collect())
    assert got == ["empty value", "unknown"]
