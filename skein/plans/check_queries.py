"""Queries of the operators that check requests, mappings and eval results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import checks, evals
from skein.plans.registry import query


# -- filters from orders: the priority picks the operator, the status the field
@query("filt_12_violations", """WITH f AS (SELECT o_orderkey AS query_id, CASE o_orderstatus WHEN 'O' THEN 'price' WHEN 'F' THEN 'status' ELSE 'cost' END AS field, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'eq' WHEN 2 THEN 'gt' WHEN 3 THEN 'in' WHEN 4 THEN 'contains' ELSE 'like' END AS op, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'x' ELSE '12' END AS value FROM orders)
SELECT * FROM (SELECT *, CASE WHEN field = 'cost' THEN 'sensitive' WHEN op = 'like' OR (field = 'price' AND op = 'contains') OR (field = 'status' AND op = 'gt') THEN 'operator' WHEN value = ' ' THEN 'empty value' WHEN field = 'price' AND value = 'x' THEN 'wrong type' END AS reason FROM f) WHERE reason IS NOT NULL""")
def _(t):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    ops = F.array(*map(F.lit, ["eq", "gt", "in", "contains", "like"]))
    f = t("orders").select(
        k.alias("query_id"), F.when(s == "O", "price").when(s == "F", "status").otherwise("cost").alias("field"),
        F.element_at(ops, F.substring("o_orderpriority", 1, 1).cast("int")).alias("op"), F.when(k % 4 == 0, " ").when(k % 4 == 1, "x").otherwise("12").alias("value"))
    name = F.col("field")
    fields = f.select("field").distinct().select(
        "field", F.when(name == "status", "string").otherwise("number").alias("kind"), (name == "cost").alias("sensitive"),
        F.lit(True).alias("visible"), F.lit(True).alias("filterable"), F.lit(False).alias("fixed"))
    return checks.filter_violations(f, fields)


@query("prof_16_redact", "SELECT 'part' AS \"table\", p_brand AS \"column\", CASE WHEN p_brand LIKE '%1%' THEN '' ELSE array_to_string(list_sort(list(DISTINCT p_type)), '|') END AS top FROM part GROUP BY p_brand")
def _(t):
    p = t("part").groupBy(F.lit("part").alias("table"), F.col("p_brand").alias("column")).agg(F.array_sort(F.collect_set("p_type")).alias("top"))
    fields = p.select("table", "column", F.col("column").like("%1%").alias("sensitive"))
    return checks.redact_profile(p, fields).withColumn("top", F.array_join("top", "|"))


@query("prof_17_mapping", """WITH p AS (SELECT DISTINCT p_brand AS "table", string_split(p_name, ' ')[2] AS "column" FROM part WHERE p_brand <> 'Brand#3'), r AS (SELECT p_partkey, p_brand AS "table", string_split(p_name, ' ')[2] || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END AS "column", p_size % 2 = 0 AS num, p_partkey % 3 = 0 AS tpl, p_partkey % 5 = 0 AS sens FROM part),
j AS (SELECT r.*, "table" IN (SELECT "table" FROM p) AS known, ("table", "column") IN (SELECT ("table", "column") FROM p) AS has FROM r), u AS (SELECT *, unnest(list_filter([CASE WHEN NOT known THEN 'unknown table' END, CASE WHEN known AND NOT has THEN 'unknown column' END, CASE WHEN tpl AND sens THEN 'sensitive in template' END, CASE WHEN has AND num AND "column" NOT LIKE 'b%' THEN 'incompatible type' END], lambda x: x IS NOT NULL)) AS reason FROM j)
SELECT CAST(p_partkey AS VARCHAR) AS entity, "table", "column", CASE WHEN tpl THEN 'template' ELSE 'field' END AS use, reason FROM u""")
def _(t):
    word, k = F.element_at(F.split("p_name", " "), 2), F.col("p_partkey")
    p = t("part").where("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("table"), word.alias("column")).distinct()
    p = p.withColumn("type", F.when(F.col("column").startswith("b"), "number").otherwise("string"))
    refs = t("part").select(
        k.cast("string").alias("entity"), F.col("p_brand").alias("table"), F.concat(word, F.when(k % 7 == 0, "x").otherwise("")).alias("column"),
        F.when(F.col("p_size") % 2 == 0, "number").otherwise("text").alias("kind"), F.when(k % 3 == 0, "template").otherwise("field").alias("use"), (k % 5 == 0).alias("sensitive"))
    return checks.mapping_violations(refs, p, {"number": ["number"], "text": ["string", "number"]})


@query("map_1_route", "SELECT o_orderkey, o_orderpriority AS \"table\", CASE WHEN o_orderpriority LIKE '1%' THEN 'a' ELSE 'b' END AS entity FROM orders WHERE o_orderpriority NOT LIKE '5%'")
def _(t):
    rows = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("table"))
    known = rows.select("table").distinct().where("table not like '5%'")
    mapping = known.select(F.lit("b").alias("entity"), "table", F.lit(2).alias("place")).unionByName(known.where("table like '1%'").select(F.lit("a").alias("entity"), "table", F.lit(1).alias("place")))
    return checks.route_entities(rows, mapping)


@query("map_15_shape", "SELECT p_partkey, p_name, p_type FROM part")
def _(t):
    return checks.shape_output(t("part"), [("p_name", True, False), ("p_brand", False, False), ("p_type", True, False), ("p_retailprice", True, True)], ["p_partkey"])


def _results(t):
    w = Window.partitionBy("case_id").orderBy(F.desc("o_totalprice"), "id")
    rows = t("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    return rows.withColumn("rank", F.row_number().over(w))


RES = "res AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


@query("eval_1_cases", f"WITH {RES} SELECT c_custkey AS case_id, coalesce(ids, '') AS ids FROM customer LEFT JOIN (SELECT case_id, string_agg('X' || id, ',' ORDER BY rank) AS ids FROM res WHERE rank <= 10 GROUP BY 1) ON c_custkey = case_id")
def _(t):
    records = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("X"), "o_orderkey").alias("external_id"))
    out = evals.run_cases(t("customer").select(F.col("c_custkey").alias("case_id")), _results(t), records)
    return out.withColumn("ids", F.array_join("ids", ","))


@query("eval_3_top", f"WITH {RES}, w AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rank FROM res WHERE o_orderstatus = 'O') SELECT w.case_id, bool_and(coalesce(r.id = w.id, false)) AS passed FROM w LEFT JOIN res r ON r.case_id = w.case_id AND r.rank = w.rank WHERE w.rank <= 2 GROUP BY 1")
def _(t):
    r = _results(t)
    want = r.where("o_orderstatus = 'O'").select("case_id", "id", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")).alias("rank")).where("rank <= 2")
    return evals.expected_top(r.select("case_id", "id", "rank"), want)


@query("eval_5_required", "SELECT o_orderkey AS case_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = f) THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders, (SELECT unnest(['R', 'N']) AS f) GROUP BY 1")
def _(t):
    row = lambda case, value: [F.col(case).alias("case_id"), F.lit("flag").alias("field"), F.lit("eq").alias("op"), value.alias("value")]
    required = t("orders").select(*row("o_orderkey", F.explode(F.array(F.lit("R"), F.lit("N")))))
    return evals.required_filters(t("lineitem").select(*row("l_orderkey", F.col("l_returnflag"))), required)


@query("eval_6_fields", "SELECT user_id AS case_id, f AS field, f = 'cost' AS forbidden, count(*) FILTER ((f = 'cost') = (event_type = 'error' AND f = 'cost' OR f = 'k')) AS violations FROM events, (SELECT unnest(['cost', 'k']) AS f) GROUP BY 1, 2")
def _(t):
    data = F.when(F.col("event_type") == "error", F.lit('{"cost": 1, "k": 2}')).otherwise(F.col("props"))
    results = t("events").select(F.col("user_id").alias("case_id"), data.alias("data"))
    fields = F.explode(F.array(F.lit("cost"), F.lit("k")))
    rules = results.select("case_id").distinct().select("case_id", fields.alias("field")).withColumn("forbidden", F.col("field") == "cost")
    return evals.field_presence(results, rules)


@query("eval_8_verdict", "SELECT l_orderkey AS case_id, count(*) FILTER (l_returnflag = 'R') = 0 AS passed, coalesce(array_to_string(list_sort(list(DISTINCT l_linestatus) FILTER (l_returnflag = 'R')), ','), '') AS reasons FROM lineitem GROUP BY 1")
def _(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_returnflag") != "R").alias("passed"), F.col("l_linestatus").alias("reason"))
    return evals.verdict(c).withColumn("reasons", F.array_join("reasons", ","))


@query("eval_10_sets", """WITH s AS (SELECT o_orderkey AS set_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS source_id, o_custkey % 25 AS workspace_id, o_orderdate AS u FROM orders)
SELECT c_custkey AS source_id, coalesce(own, shared) AS set_id FROM customer LEFT JOIN (SELECT source_id, max_by(set_id, (u, set_id)) AS own FROM s WHERE source_id IS NOT NULL GROUP BY 1) a ON a.source_id = c_custkey LEFT JOIN (SELECT workspace_id, max_by(set_id, (u, set_id)) AS shared FROM s WHERE source_id IS NULL GROUP BY 1) b ON b.workspace_id = c_custkey % 25""")
def _(t):
    sets = t("orders").select(F.col("o_orderkey").alias("set_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("source_id"), (F.col("o_custkey") % 25).alias("workspace_id"), F.col("o_orderdate").alias("updated_at"))
    return evals.applicable_set(t("customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 25).alias("workspace_id")), sets)


@query("eval_11_gate", """WITH r AS (SELECT l_suppkey AS set_id, max_by((l_discount * 10, CAST(l_quantity > 45 AS INTEGER), l_shipdate), (l_shipdate, l_discount * 10, CAST(l_quantity > 45 AS INTEGER))) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT l_suppkey AS source_id, max(l_shipdate) AS ch FROM lineitem WHERE l_tax = 0 GROUP BY 1)
SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 5 = 0 THEN 'not validated' WHEN s_suppkey % 7 = 0 THEN 'no set' WHEN r IS NULL THEN 'no run' WHEN r[3] <= ch THEN 'stale run' WHEN r[1] < 0.8 THEN 'low score' WHEN r[2] > 0 THEN 'leaks' END AS reason FROM supplier LEFT JOIN r ON set_id = s_suppkey LEFT JOIN c ON source_id = s_suppkey""")
def _(t):
    k = F.col("s_suppkey")
    sources = t("supplier").select(k.alias("source_id"), F.when(k % 7 != 0, k).alias("set_id"), F.when(k % 5 == 0, "indexed").otherwise("validated").alias("state"))
    li = t("lineitem")
    runs = li.select(F.col("l_suppkey").alias("set_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") > 45).cast("int").alias("leaks"), F.col("l_shipdate").alias("finished_at"))
    return evals.activation_gate(sources, runs, li.where("l_tax = 0").select(F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("changed_at")))


@query("eval_12_promotable", "SELECT DISTINCT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN l_suppkey ELSE o_custkey END AS source_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND (o_orderkey % 3 <> 0 OR l_suppkey IS NOT NULL)")
def _(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("source_id"), (F.col("o_orderstatus") == "O").alias("passed"))
    return evals.promotable(runs, t("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("source_id")))


@query("eval_13_stale", "SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20 11:45:00'")
def _(t):
    runs = t("events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"), F.col("ts").alias("started_at"))
    return evals.stale_runs(runs, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id")
