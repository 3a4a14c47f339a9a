"""Findings 21 and 22 of round 3: parts of the shuffles that grow with the input."""

import __spark_entry__ as entry
from skein.operators import parts, rank, relations


def test_rescore_in_any_number_of_parts(spark, sf, monkeypatch):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey query_id", "l_partkey id", "l_returnflag field", "l_discount boost", "l_quantity score")
    hits, matches = li.select("query_id", "id", "score").dropDuplicates(["query_id", "id"]).localCheckpoint(), li.drop("score")
    want = sorted(rank.rescore(hits, matches).collect())
    got = rank.rescore(hits, matches, parts=23)
    assert sorted(got.collect()) == want and got.rdd.getNumPartitions() == 23
    assert parts.parts_of(li, 100) == -(-li.count() // 100) and parts.parts_of(li.limit(0)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("skein.plans.queries.parts_of", lambda t: parts.parts_of(t, 500))
    assert entry.queries()["rank_10_11_rescore"](spark, sf).rdd.getNumPartitions() == -(-li.count() // 500)


def test_first_seen_labels_in_any_number_of_parts(spark, sf, monkeypatch):
    orders, li, part = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("orders", "lineitem", "part"))
    args = (orders, li, part, "o_orderkey", "l_orderkey", "l_partkey", "p_partkey", "p_name", ["l_linenumber"])
    want = sorted(relations.relation_labels(*args).collect())
    got = relations.relation_labels(*args, parts=23)
    assert sorted(got.collect()) == want and got.rdd.getNumPartitions() == 23
    monkeypatch.setattr("skein.plans.relation_queries.parts_of", lambda t: parts.parts_of(t, 500))
    assert entry.queries()["map_7_first_seen"](spark, sf).rdd.getNumPartitions() == -(-li.count() // 500)
