"""Reads from a database in Derby's memory: choice of tables, catalog, parts, pushed filters."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from skein.operators.raw import classify_tables
from skein.plans.jdbc_queries import drop_database
from skein.sources import jdbc
from skein.sources.readers import read_increment

URL = "jdbc:derby:memory:jdbc_tests"
DDL = [
    "CREATE SCHEMA s", "CREATE SCHEMA x",
    "CREATE TABLE s.item (id BIGINT NOT NULL PRIMARY KEY, name VARCHAR(40), moment TIMESTAMP)",
    "CREATE TABLE s.tag (code VARCHAR(40) NOT NULL PRIMARY KEY, label VARCHAR(40))",
    "CREATE TABLE s.item_tag (item BIGINT NOT NULL REFERENCES s.item (id), tag VARCHAR(40) NOT NULL REFERENCES s.tag (code), PRIMARY KEY (tag, item))",
    "CREATE TABLE s.day (d DATE NOT NULL PRIMARY KEY, n INT)", "CREATE TABLE s.empty (id INT NOT NULL PRIMARY KEY)",
    "CREATE TABLE s.flags (f BOOLEAN NOT NULL PRIMARY KEY)", "CREATE TABLE s.loose (v INT)", "CREATE TABLE x.tag (code INT NOT NULL PRIMARY KEY)",
    "CREATE VIEW s.seen AS SELECT v FROM s.loose",
    # keys that are very unevenly spread: even ranges of values would put all but one row into one part
    "INSERT INTO s.item VALUES " + ", ".join(f"({k}, 'n{k}', TIMESTAMP('2024-01-01 00:00:{k % 60:02d}'))" for k in range(99)) + ", (1000000000000, NULL, NULL)",
    "INSERT INTO s.tag VALUES ('it''s', 'a'), ('b', 'b'), ('', 'blank'), ('é\"', 'q')", "INSERT INTO s.item_tag VALUES (1, 'b'), (1, 'it''s'), (2, 'b')",
    "INSERT INTO s.day VALUES (DATE('2024-02-29'), 1), (DATE('1969-12-31'), 2), (DATE('2024-03-01'), 3)", "INSERT INTO s.flags VALUES (true), (false)",
    "INSERT INTO s.loose VALUES (1), (1), (NULL)", "INSERT INTO x.tag VALUES (7)",
]


@pytest.fixture(scope="module")
def url(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    with jdbc.connect(spark, URL + ";create=true") as c:
        statement = c.createStatement()
        for line in DDL:
            statement.execute(line)
    yield URL
    drop_database(spark, URL)


def names(spark, url, *a, **k):
    return sorted(jdbc.read_jdbc_tables(spark, url, *a, **k)[0])


def test_choice(spark, url):
    assert names(spark, url, schema="S") == ["DAY", "EMPTY", "FLAGS", "ITEM", "ITEM_TAG", "TAG"]  # those with a key
    assert names(spark, url, [], schema="X") == ["TAG"]
    assert names(spark, url, ["LOOSE", "X.TAG"]) == ["LOOSE", "TAG"]
    assert names(spark, url, ["TAG"]) == ["S.TAG", "X.TAG"]
    assert names(spark, url, ["SEEN", "NOWHERE"]) == []  # a view isn't a table


def test_catalog(spark, url):
    catalog = jdbc.read_catalog(spark, url, "S")
    keys = {(r.column, r.referenced_table, r.referenced_column, r.key_place) for r in catalog.where("table = 'ITEM_TAG'").collect()}
    assert keys == {("ITEM", "ITEM", "ID", 2), ("TAG", "TAG", "CODE", 1)}
    roles = {r.table: r.role for r in classify_tables(catalog).collect()}
    assert roles["ITEM_TAG"] == "junction" and roles["ITEM"] == "lookup"
    assert {(r.column, r.role) for r in jdbc.foreign_keys(catalog).collect()} == {("ITEM", "junction"), ("TAG", "junction")}


def test_rows_and_parts(spark, url):
    tables, _ = jdbc.read_jdbc_tables(spark, url, ["ITEM", "S.TAG", "DAY", "EMPTY", "FLAGS", "LOOSE", "ITEM_TAG"], "S", parts=4)
    count = {n: df.count() for n, df in tables.items()}
    assert count == {"ITEM": 100, "TAG": 4, "DAY": 3, "EMPTY": 0, "FLAGS": 2, "LOOSE": 3, "ITEM_TAG": 3}
    sizes = [r["count"] for r in tables["ITEM"].groupBy(F.spark_partition_id()).count().collect()]
    assert sizes == [25] * 4  # equal parts though one key is far away
    assert tables["TAG"].rdd.getNumPartitions() == 4 and {r.CODE for r in tables["TAG"].collect()} == {"it's", "b", "", 'é"'}
    assert {str(r.D) for r in tables["DAY"].collect()} == {"2024-02-29", "1969-12-31", "2024-03-01"}
    assert tables["LOOSE"].rdd.getNumPartitions() == tables["FLAGS"].rdd.getNumPartitions() == 1


def test_increment_is_pushed(spark, url):
    item = jdbc.read_jdbc_tables(spark, url, ["ITEM"], parts=4)[0]["ITEM"]
    new = read_increment(item.select("ID", "MOMENT"), "MOMENT", "ID", ("2024-01-01 00:00:37", 50))
    assert sorted(r.ID for r in new.collect()) == sorted([*range(38, 60), 97, 98])
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(MOMENT" in plan and "NAME" not in plan


def test_a_database_that_every_jvm_can_open(tmp_path):
    """On executors of their own, which a database in one JVM's memory can't serve."""
    code = f"""
import sys
sys.path[:0] = [{ROOT!r}, {ROOT + "/tests"!r}]
from compare import connect, same
from pyspark.sql import SparkSession
from skein.plans.queries import QUERIES, SQL
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print("rows", same(spark, connect("/root/testdata/sf0.001"), QUERIES["src_2_increment"], SQL["src_2_increment"], "/root/testdata/sf0.001"))
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
