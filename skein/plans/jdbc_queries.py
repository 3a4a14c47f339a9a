"""Queries of tables that are read from a database: Derby, which comes with Spark.

Derby lets one JVM at a time open a database that can change, but any number one that lies
in a jar. So the driver's Derby takes the rows in from files that the executors wrote,
part by part, and closes the database; it is then packed, without compression (a page is
found by its place), into a jar in the folder that driver and executors share, where each
JVM reads it by the same URL. That folder has to be in the file system, as Derby opens no other.
"""

from __future__ import annotations

import os
import zipfile
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from skein.operators import relations
from skein.plans.more_queries import scratch
from skein.plans.registry import session_query
from skein.sources import jdbc
from skein.sources.readers import read_increment, read_table

DDL = [
    'CREATE TABLE "nation" ("n_nationkey" BIGINT NOT NULL, "n_name" VARCHAR(100), "title" VARCHAR(100))',
    'CREATE TABLE "supplier" ("s_suppkey" BIGINT NOT NULL, "s_name" VARCHAR(100), "s_acctbal" DOUBLE, "s_nationkey" BIGINT)',
    'CREATE TABLE "served" ("s_suppkey" BIGINT NOT NULL, "n_nationkey" BIGINT NOT NULL, "orders" BIGINT)',
    'CREATE TABLE "brand" ("name" VARCHAR(60) NOT NULL, "parts" BIGINT)',
    'CREATE TABLE "no_key" ("word" VARCHAR(100))',
]
#: Added when the rows are there: an index is built faster than it is kept up.
KEYS = [
    'ALTER TABLE "nation" ADD PRIMARY KEY ("n_nationkey")',
    'ALTER TABLE "supplier" ADD PRIMARY KEY ("s_suppkey")',
    'ALTER TABLE "supplier" ADD FOREIGN KEY ("s_nationkey") REFERENCES "nation" ("n_nationkey")',
    'ALTER TABLE "served" ADD PRIMARY KEY ("s_suppkey", "n_nationkey")',
    'ALTER TABLE "served" ADD FOREIGN KEY ("s_suppkey") REFERENCES "supplier" ("s_suppkey")',
    'ALTER TABLE "served" ADD FOREIGN KEY ("n_nationkey") REFERENCES "nation" ("n_nationkey")',
    'ALTER TABLE "brand" ADD PRIMARY KEY ("name")',
]


def _load(spark, statement, name, df, folder) -> None:
    """Takes rows into a table in the order of its first column, by Derby's own import of CSV files."""
    path = f"{folder}/{name}"
    df.sort(df.columns[0]).write.option("escape", '"').option("emptyValue", '""').csv(path)
    for file in sorted(spark.read.text(path).inputFiles()):
        statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE('APP', '{name}', '{_local(file)}', NULL, NULL, 'UTF-8', 0)")


def _local(uri: str) -> str:
    """The path of a file: URI."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"Derby opens files of the file system only: {uri}")
    return unquote(parts.path).replace("'", "''")


def _pack(folder: str, jar: str) -> None:
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_STORED) as out:
        for top, _, files in os.walk(folder):
            for name in files:
                if not name.endswith(".lck"):
                    out.write(f"{top}/{name}", os.path.relpath(f"{top}/{name}", os.path.dirname(folder)))


@contextmanager
def _database(spark, sf_dir):
    """A new database with nations, suppliers, which nations' orders they serve, and brands."""
    folder = scratch(spark)
    home = _local(folder)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    t = lambda n: read_table(spark, sf_dir, n)
    served = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    served = served.groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("o_orderkey").alias("orders"))
    rows = {
        "nation": t("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).otherwise("").alias("title")), "supplier": t("supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), "served": served,
        "brand": t("part").groupBy(F.concat("p_brand", F.lit("'s "), "p_size").alias("name")).agg(F.count("*").alias("parts")), "no_key": t("nation").select(F.col("n_name").alias("word")),
    }
    os.makedirs(home, exist_ok=True)
    made = f"jdbc:derby:{home}/db"
    try:
        with jdbc.connect(spark, made + ";create=true") as c:
            statement = c.createStatement()
            for line in DDL:
                statement.execute(line)
            for name, df in rows.items():
                _load(spark, statement, name, df, folder)
            for line in KEYS:
                statement.execute(line)
    finally:
        close_database(spark, made)
    _pack(f"{home}/db", f"{home}/db.jar")
    url = f"jdbc:derby:jar:({home}/db.jar)db"
    try:
        yield url
    finally:
        close_database(spark, url)


def close_database(spark, url: str, how: str = "shutdown") -> None:
    """Ends the driver's use of a database; Derby reports the end itself as an error."""
    try:
        with jdbc.connect(spark, f"{url};{how}=true"):
            pass
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() not in ("08006", "XJ004"):  # closed, or never opened
            raise


def drop_database(spark, url: str) -> None:
    """Frees a database in memory."""
    close_database(spark, url, "drop")


def _kept(spark, out):
    """The rows, stored before their database goes."""
    path = scratch(spark)
    out.write.parquet(path)
    return spark.read.parquet(path)


@session_query("src_2_jdbc", """SELECT 'brand' AS tab, p_brand || '''s ' || p_size AS id, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_nationkey FROM supplier UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), length(n_name) FROM nation
UNION ALL SELECT 'served', l_suppkey || ':' || c_nationkey, count(DISTINCT o_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_suppkey, c_nationkey""")
def _(spark, sf_dir):
    with _database(spark, sf_dir) as url:
        tables, _ = jdbc.read_jdbc_tables(spark, url, schema="APP")
        ids = {"brand": ("name", "parts"), "supplier": ("s_suppkey", "s_nationkey"), "nation": ("n_nationkey", F.length("n_name")), "served": (F.concat_ws(":", "s_suppkey", "n_nationkey"), "orders")}
        out = None
        for name in sorted(tables):
            rows = tables[name].select(F.lit(name).alias("tab"), (ids[name][0] if not isinstance(ids[name][0], str) else F.col(ids[name][0])).cast("string").alias("id"), (F.col(ids[name][1]) if isinstance(ids[name][1], str) else ids[name][1]).cast("long").alias("n"))
            out = rows if out is None else out.unionByName(rows)
        return _kept(spark, out)


@session_query("src_2_increment", "SELECT s_suppkey, s_name FROM supplier WHERE (s_nationkey, s_suppkey) > (12, (SELECT max(s_suppkey) // 2 FROM supplier))")
def _(spark, sf_dir):
    with _database(spark, sf_dir) as url:
        tables, _ = jdbc.read_jdbc_tables(spark, url, ["APP.supplier"])
        half = read_table(spark, sf_dir, "supplier").agg(F.floor(F.max("s_suppkey") / 2)).first()[0]
        return _kept(spark, read_increment(tables["supplier"], "s_nationkey", "s_suppkey", (12, half)).select("s_suppkey", "s_name"))


@session_query("src_2_relations", """WITH n AS (SELECT n_nationkey AS k, n_name AS label FROM nation WHERE n_nationkey % 3 > 0), d AS (SELECT DISTINCT l_suppkey, label, k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN n ON k = c_nationkey)
SELECT s_suppkey, coalesce(string_agg(label, ' ' ORDER BY k), '') AS relation_text FROM supplier LEFT JOIN d ON l_suppkey = s_suppkey GROUP BY 1""")
def _(spark, sf_dir):
    with _database(spark, sf_dir) as url:
        tables, catalog = jdbc.read_jdbc_tables(spark, url, schema="APP")
        return _kept(spark, relations.auto_relation_text(tables, jdbc.foreign_keys(catalog), "supplier", "s_suppkey"))
