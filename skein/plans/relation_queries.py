"""Queries of related rows' labels, with the ways between tables read from foreign keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import relations
from skein.operators.parts import parts_of
from skein.plans.registry import query


def _tables(t):
    """Tables with plain column names; returns and refunds are junctions of their own. A
    part whose brand has a 1 is without name, a small one without description too."""
    plain = lambda df: df.toDF(*[c.partition("_")[2] or c for c in df.columns])
    out = {n: plain(t(n)) for n in ("supplier", "part", "orders", "lineitem")}
    out["part"] = out["part"].withColumn("name", F.when(~F.col("brand").like("%1%"), F.col("name"))).withColumn("description", F.when(F.col("size") > 5, F.concat("brand", F.lit(" "), "size")))
    out["returns"] = out["lineitem"].where("returnflag = 'R'").select("suppkey", "partkey", "shipdate", "orderkey")
    out["refunds"] = out["lineitem"].where("returnflag = 'A' and discount > 0.05").select(F.col("suppkey").alias("from_supplier"), F.col("suppkey").alias("to_supplier"), "orderkey").where("orderkey % 5 = 0")
    return out


def _catalog(spark, tables):
    """A foreign key for each column that is named as another table's first column; refunds have two to one table."""
    keys = {df.columns[0]: n for n, df in tables.items() if n not in ("lineitem", "returns", "refunds")}
    found = [(n, c, keys[c]) for n, df in tables.items() for c in df.columns if keys.get(c, n) != n]
    found += [("refunds", c, "supplier") for c in ("from_supplier", "to_supplier")]
    rows = [(n, "junction" if n in ("lineitem", "returns", "refunds") else "entity", k, c, to, "suppkey" if to == "supplier" else c) for k, (n, c, to) in enumerate(found)]
    return spark.createDataFrame(rows, "table string, role string, place int, column string, referenced_table string, referenced_column string")


#: lineitem leads from a supplier to orders (no name: their key), returns to parts.
AUTO = """WITH p AS (SELECT p_partkey, CAST(coalesce(CASE WHEN p_brand NOT LIKE '%1%' THEN p_name END, CASE WHEN p_size > 5 THEN p_brand || ' ' || p_size END, CAST(p_partkey AS VARCHAR)) AS VARCHAR) AS label FROM part),
r AS (SELECT l_suppkey AS k, 1 AS n, CAST(l_orderkey AS VARCHAR) AS label, min((DATE '1970-01-01', l_orderkey)) AS seen FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2, 3
UNION ALL SELECT l_suppkey, 2, label, min((CAST(l_shipdate AS DATE), l_partkey)) FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
f AS (SELECT k, label, min((n, seen)) AS seen FROM r GROUP BY 1, 2)
SELECT s_suppkey AS suppkey, coalesce(string_agg(label, ' ' ORDER BY seen), '') AS relation_text FROM supplier LEFT JOIN f ON k = s_suppkey GROUP BY 1"""


@query("map_8_from_catalog", AUTO)
def _(t):
    tables = _tables(t)
    catalog = _catalog(t("supplier").sparkSession, tables).where("table <> 'refunds'")
    return relations.auto_relation_text(tables, catalog, "supplier", "suppkey", {"returns": ["shipdate"]})


@query("map_8_same_table", """WITH r AS (SELECT DISTINCT l_orderkey AS k, l_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A' AND l_discount > 0.05 AND l_orderkey % 5 = 0),
s AS (SELECT DISTINCT l_suppkey AS k, s_name FROM r)
SELECT 'order ' || o_orderkey AS id, coalesce(string_agg(s_name, ' ' ORDER BY l_suppkey), '') AS relation_text FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY 1
UNION ALL SELECT 'supplier ' || s_suppkey, coalesce(s.s_name, '') FROM supplier LEFT JOIN s ON k = s_suppkey""")
def _(t):
    tables = _tables(t)
    catalog = _catalog(t("supplier").sparkSession, tables).where("table = 'refunds'").withColumn("place", F.when(F.col("referenced_table") == "orders", 99).otherwise(F.col("place")))
    text = lambda name, key: relations.auto_relation_text(tables, catalog, name, key)
    named = lambda df, kind: df.select(F.concat(F.lit(kind + " "), df.columns[0]).alias("id"), "relation_text")
    return named(text("orders", "orderkey"), "order").unionByName(named(text("supplier", "suppkey"), "supplier"))


@query("map_7_first_seen", """WITH f AS (SELECT l_orderkey AS k, p_name AS label, min((l_linenumber, l_partkey)) AS seen FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name <> '' GROUP BY 1, 2)
SELECT o_orderkey AS orderkey, count(label) AS n, coalesce(string_agg(label, ' ' ORDER BY seen), '') AS search_text FROM orders LEFT JOIN f ON k = o_orderkey GROUP BY 1""")
def _(t):
    out = relations.relation_labels(t("orders").withColumnRenamed("o_orderkey", "orderkey"), t("lineitem"), t("part"), "orderkey", "l_orderkey", "l_partkey", "p_partkey", "p_name", ["l_linenumber"], parts_of(t("lineitem")))
    return out.select("orderkey", F.size("labels").alias("n"), "search_text")
