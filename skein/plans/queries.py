"""The registered queries over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import embed, evals, filters, mapping, ops, profile, rank, raw, search
from skein.operators.parts import parts_of, spread
from skein.plans import check_queries, jdbc_queries, lexical_queries, member_queries, mention_queries, more_queries, relation_queries, scoped_queries, search_queries, store_queries, stream_queries, suggested_queries, verdict_queries  # noqa: F401 (they register their queries)
from skein.plans.registry import QUERIES, SQL, query
from skein.sources.readers import next_cursor, read_increment, read_table, read_with_overlap
from skein.streaming.streams import rolling_metrics

# -- stored and incoming orders: every 7th changed, every 11th gone, keys from 2^40 new
def _stored(t):
    return t("orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderstatus"), F.col("o_orderpriority")), 256).alias("hash"))


def _incoming(t):
    status = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    rows = t("orders").where("o_orderkey % 11 <> 0")
    key = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") + (1 << 40)).otherwise(F.col("o_orderkey"))
    return rows.select(key.alias("o_orderkey"), F.sha2(F.concat_ws("|", status, F.col("o_orderpriority")), 256).alias("hash"))


S = "stored AS (SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS hash FROM orders)"
I = (
    "incoming AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1099511627776 ELSE o_orderkey END AS o_orderkey,"
    " sha256((CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) || '|' || o_orderpriority) AS hash FROM orders WHERE o_orderkey % 11 <> 0)"
)


@query("raw_1_payload_hash", """SELECT c_custkey, sha256('{"c_mktsegment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c_name":"' || c_name || '|c_nationkey=' || c_custkey % 5 || '","c_nationkey":' || c_nationkey || '}') AS hash FROM customer""")
def _(t):
    name = F.concat("c_name", F.lit("|c_nationkey="), F.col("c_custkey") % 5)
    rows = t("customer").select("c_custkey", name.alias("c_name"), "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rows.select("c_custkey", raw.payload_hash("c_name", "c_nationkey", "c_mktsegment").alias("hash"))


@query("raw_2_record_id", "SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber AS rid, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").select(raw.source_record_id("lineitem", "l_orderkey", "l_linenumber").alias("rid")).groupBy("rid").agg(F.count("*").alias("n"))


@query("raw_3_split_id", "SELECT o_orderkey, 'orders' AS tab, o_orderkey || ':' || o_custkey AS ext FROM orders")
def _(t):
    a, b = raw.split_record_id(F.concat(F.lit("orders:"), F.col("o_orderkey"), F.lit(":"), F.col("o_custkey")))
    return t("orders").select("o_orderkey", a.alias("tab"), b.alias("ext"))


@query("raw_4_csv_id", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_brand || ':' || substr(sha256(p_name), 1, 16) ELSE 'row:' || substr(sha256(p_name), 1, 16) END AS rid FROM part")
def _(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", raw.csv_record_id(F.when(k % 3 == 0, k.cast("string")), F.when(k % 3 == 1, F.col("p_brand")), F.sha2("p_name", 256)).alias("rid"))


@query("raw_5_diff", f"WITH {S}, {I} SELECT i.o_orderkey, CASE WHEN s.hash IS NULL THEN 'new' WHEN s.hash <> i.hash THEN 'changed' ELSE 'unchanged' END AS state FROM incoming i LEFT JOIN stored s USING (o_orderkey)")
def _(t):
    return raw.diff_by_hash(_incoming(t), _stored(t), ["o_orderkey"]).select("o_orderkey", "state")


@query("raw_6_transitions", """WITH b AS (SELECT user_id, event_type AS hash, event_id FROM events), x AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id, hash) AS p FROM b)
SELECT user_id, CAST(sum(CASE WHEN coalesce(p, CASE WHEN user_id % 2 = 0 THEN 'view' END) IS DISTINCT FROM hash THEN 1 ELSE 0 END) AS BIGINT) AS transitions, max_by(hash, event_id) AS hash FROM x GROUP BY user_id""")
def _(t):
    e = t("events").select("user_id", F.col("event_type").alias("hash"), "event_id")
    stored = e.where("user_id % 2 = 0").select("user_id").distinct().withColumn("hash", F.lit("view"))
    return raw.count_transitions(e, stored, ["user_id"], "event_id")


@query("raw_7_upsert", f"""WITH {S}, {I} SELECT coalesce(i.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(i.hash, s.hash) AS hash, CASE WHEN s.hash IS NULL THEN 2 ELSE 1 END AS created_at,
CASE WHEN i.hash IS NULL OR i.hash = s.hash THEN 1 ELSE 2 END AS synced_at FROM stored s FULL JOIN incoming i ON s.o_orderkey = i.o_orderkey""")
def _(t):
    stored = _stored(t).withColumns({"created_at": F.lit(1), "synced_at": F.lit(1)})
    return raw.upsert(stored, _incoming(t), ["o_orderkey"], F.lit(2))


@query("raw_8_stale_by_table", "SELECT o_orderpriority AS tab, count(*) AS n FROM orders WHERE NOT (o_orderpriority LIKE '1%' AND o_orderkey % 5 = 0) GROUP BY 1")
def _(t):
    s = t("orders").select(F.col("o_orderpriority").alias("table"), F.col("o_orderkey").alias("id"))
    left = raw.remove_stale_by_table(s, s.where("id % 5 <> 0"), s.where("table like '1%'").select("table").distinct())
    return left.groupBy(F.col("table").alias("tab")).agg(F.count("*").alias("n"))


@query("raw_9_stale", f"WITH {S}, {I} SELECT s.* FROM stored s SEMI JOIN incoming i USING (o_orderkey)")
def _(t):
    return raw.remove_stale(_stored(t), _incoming(t), ["o_orderkey"])


@query("raw_10_stale_by_prefix", "SELECT p_name, count(*) AS n FROM part WHERE NOT (p_name LIKE 'b%' AND p_partkey % 2 = 1) GROUP BY 1")
def _(t):
    s = t("part").select("p_name", F.concat_ws(":", "p_name", "p_partkey").alias("k"), "p_partkey")
    return raw.remove_stale_by_prefix(s, "b", s.where("p_partkey % 2 = 0"), "k").groupBy("p_name").agg(F.count("*").alias("n"))


@query("raw_11_stale_children", """WITH live AS (SELECT * FROM lineitem WHERE l_linenumber <> 2), r AS (SELECT l_orderkey FROM live GROUP BY 1 HAVING count(*) < 4)
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem l WHERE NOT (l_orderkey IN (SELECT l_orderkey FROM r) AND l_linenumber = 2) GROUP BY 1, 2""")
def _(t):
    s = t("lineitem").select("l_orderkey", "l_linenumber")
    out = raw.remove_stale_children(s, s.where("l_linenumber <> 2"), "l_orderkey", ["l_orderkey", "l_linenumber"], 4)
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("raw_12_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return raw.delete_rows(t("orders"), t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("raw_13_delete_parent", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    gone = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return raw.delete_rows(t("lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("src_3_increment", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 50)")
def _(t):
    return read_increment(t("events"), "ts", "event_id", ("2024-01-10 00:00:00", 50)).select("event_id", "ts")


@query("src_4_next_cursor", "SELECT event_type, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(t):
    return next_cursor(t("events"), "event_type", "ts", "event_id")


@query("src_5_overlap", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-14 23:55:00'")
def _(t):
    return read_with_overlap(t("events"), "ts", "2024-01-15 00:00:00").select("event_id")


# -- profiles of part and customer
LONG = "long AS (SELECT 'p_name' AS \"column\", p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part)"


def _long(t):
    return profile.unpivot_values(t("part"), ["p_name", "p_brand", "p_type", "p_size"])


@query("prof_2_table_counts", "SELECT o_orderstatus AS tab, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(t):
    return profile.table_counts(t("orders").select(F.col("o_orderstatus").alias("tab")), "tab")


@query("prof_3_unpivot", f'WITH {LONG} SELECT "column", value, count(*) AS n FROM long GROUP BY 1, 2')
def _(t):
    return _long(t).groupBy("column", "value").agg(F.count("*").alias("n"))


@query("prof_4_5_9_stats", f'WITH {LONG} SELECT "column", count(*) AS rows, CAST(count(*) - count(value) AS BIGINT) AS nulls, round((count(*) - count(value)) / count(*), 6) AS null_rate, count(DISTINCT value) AS "distinct", count(DISTINCT value) BETWEEN 1 AND 50 AS enum_candidate FROM long GROUP BY 1')
def _(t):
    return profile.column_stats(_long(t))


@query("prof_6_top_values", f'WITH {LONG}, c AS (SELECT "column", value, count(*) AS n FROM long GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 20')
def _(t):
    return profile.top_values(_long(t), 20)


@query("prof_7_8_types", """WITH l AS (SELECT 'key' AS "column", CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders)
SELECT "column", CASE "column" WHEN 'key' THEN 'number' WHEN 'status' THEN 'string' ELSE 'date' END AS type, CASE WHEN "column" = 'key' THEN min(try_cast(value AS DOUBLE)) END AS min_number, CASE WHEN "column" = 'key' THEN max(try_cast(value AS DOUBLE)) END AS max_number,
CASE WHEN "column" = 'day' THEN min(value) END AS min_text, CASE WHEN "column" = 'day' THEN max(value) END AS max_text FROM l GROUP BY 1""")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return profile.infer_types(profile.unpivot_values(o, ["key", "status", "day"]))


@query("prof_10_json_shape", """WITH l AS (SELECT 'k' AS "column", json_extract_string(props, '$.k') AS value FROM events WHERE props IS NOT NULL UNION ALL SELECT 'm', CASE WHEN event_id % 2 = 0 THEN '1' ELSE event_type END FROM events WHERE props IS NOT NULL UNION ALL SELECT 'n', NULL FROM events WHERE props IS NOT NULL),
c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM c WHERE value IS NOT NULL)
SELECT c."column", CAST(sum(n) AS BIGINT) AS rows, count(value) AS "distinct", CASE WHEN count(value) = 0 THEN 'unknown' WHEN count(*) FILTER (value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) > 0 THEN 'string' ELSE 'number' END AS type, (SELECT string_agg(value, ',' ORDER BY r) FROM r WHERE r.r <= 20 AND r."column" = c."column") AS top FROM c GROUP BY 1""")
def _(t):
    other = F.concat(F.lit(', "m": '), F.when(F.col("event_id") % 2 == 0, "1").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.lit(', "n": null}'))
    rows = t("events").where("props is not null").select(F.concat(F.expr("left(props, length(props) - 1)"), other).alias("props"))
    return profile.json_shape(rows, "props").withColumn("top", F.array_join("top", ","))


@query("prof_11_atomic", "WITH m AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part), c AS (SELECT value, count(*) AS n FROM m WHERE value <> '' GROUP BY 1) SELECT value, n, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 10 AS truncated FROM c ORDER BY n DESC, value LIMIT 10")
def _(t):
    return profile.atomic_values(t("part"), F.translate("p_name", " ", ","), 10)


@query("prof_14_merge", "WITH s AS (SELECT p_partkey % 2 AS src, p_type AS value, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT value, max(n) AS n FROM s GROUP BY 1) SELECT 'part' AS entity, 'p_type' AS field, value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM m")
def _(t):
    s = t("part").groupBy((F.col("p_partkey") % 2).alias("src"), F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    return profile.merge_capabilities(s.select(F.lit("part").alias("entity"), F.lit("p_type").alias("field"), "value", "n"))


@query("prof_15_suggest", "WITH q AS (SELECT s_suppkey AS query_id, lower(substr(s_name, length(s_name) - 1)) AS q FROM supplier), h AS (SELECT query_id, p_brand AS value FROM (SELECT DISTINCT p_brand FROM part) JOIN q ON contains(lower(p_brand), q)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY value) AS INTEGER) AS rank FROM h) WHERE rank <= 10")
def _(t):
    v = t("part").select(F.lit("brand").alias("field"), F.col("p_brand").alias("value")).distinct().withColumn("norm", T.normalize_text(F.col("value")))
    q = t("supplier").select(F.col("s_suppkey").alias("query_id"), F.lit("brand").alias("field"), F.lower(F.substring("s_name", -2, 2)).alias("norm"))
    return profile.suggest_values(v, q)


# -- mapping
@query("map_2_scalar_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text FROM part")
def _(t):
    return t("part").select("p_partkey", T.number_text(F.col("p_size").cast("double")).alias("size_text"))


@query("map_4_coerce", "SELECT o_orderkey, o_orderkey % 2 = 1 AS flag, try_cast(o_orderpriority AS DOUBLE) AS num FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.coerce_boolean((F.col("o_orderkey") % 2).cast("string")).alias("flag"), F.col("o_orderpriority").try_cast("double").alias("num"))


@query("map_5_string_array", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS members FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(T.to_string_array(F.concat(F.lit(" , "), F.replace(F.col("p_name"), F.lit(" "), F.lit(" ,, ")))), "|").alias("members"))


@query("map_6_rules", "SELECT p_partkey, p_size >= 10 AND p_retailprice < 1500 AND p_type <> 'PROMO' AS ok FROM part")
def _(t):
    return t("part").select("p_partkey", mapping.apply_rule([("p_size", "gte", 10), ("p_retailprice", "lt", 1500), ("p_type", "neq", "PROMO")]).alias("ok"))


@query("map_7_relation", "WITH d AS (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT p_partkey, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS labels FROM part LEFT JOIN d ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    via = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    out = mapping.relation_aggregate(t("part"), via, t("supplier"), "p_partkey", "s_suppkey", "s_name")
    return out.select("p_partkey", F.array_join("labels", ",").alias("labels"))


@query("map_8_auto_relation", "WITH d AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT s_suppkey, coalesce(string_agg(p_brand, ' ' ORDER BY p_brand), '') AS relation_text FROM supplier LEFT JOIN d ON s_suppkey = l_suppkey GROUP BY 1")
def _(t):
    via = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    out = mapping.relation_aggregate(t("supplier"), via, t("part"), "s_suppkey", "p_partkey", "p_brand")
    return out.select("s_suppkey", F.array_join("labels", " ").alias("relation_text"))


@query("map_9_10_search_text", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS source, p_name AS a, p_brand AS b, p_type AS c FROM part")
def _(t):
    w = mapping.weighted_parts({"A": ["p_name"], "B": ["p_brand"], "C": ["p_type"]})
    return t("part").withColumn("w", w).select("p_partkey", mapping.search_source("p_name", "p_brand", "p_type").alias("source"), F.col("w.A").alias("a"), F.col("w.B").alias("b"), F.col("w.C").alias("c"))


@query("map_11_template", "SELECT p_partkey, p_name || ' by ' || p_brand || ' (' || p_size || ')' AS rendered FROM part")
def _(t):
    return t("part").select("p_partkey", mapping.render_template("{{p_name}} by {{ p_brand }} ({{p_size}})", {"p_name", "p_brand", "p_size"}).alias("rendered"))


@query("map_13_changed", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def _(t):
    new = t("part").select("p_partkey", "p_name", "p_size")
    old = new.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_size")))
    return mapping.changed_records(new, old, ["p_partkey"], ["p_name", "p_size"]).select("p_partkey")


@query("map_16_17_normalize", "SELECT doc_id, length(x) AS n, sha256(x) AS norm_hash, sha256(regexp_replace(x, '[^a-z0-9]', '', 'g')) AS id_hash FROM (SELECT doc_id, trim(lower(strip_accents(text))) AS x FROM documents)")
def _(t):
    n = T.normalize_text(F.col("text"))
    return t("documents").select("doc_id", F.length(n).cast("long").alias("n"), F.sha2(n, 256).alias("norm_hash"), F.sha2(T.normalize_identifier(F.col("text")), 256).alias("id_hash"))


@query("map_18_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS number FROM orders")
def _(t):
    shown = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    return t("orders").select("o_orderkey", F.round(T.parse_localized_number(shown), 2).alias("number"))


@query("map_19_keys", "SELECT p_partkey, regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS key, regexp_extract(p_brand, '([0-9]+)$', 1) AS digits FROM part")
def _(t):
    return t("part").select("p_partkey", T.attribute_key(F.concat_ws("  ", "p_type", "p_brand")).alias("key"), T.gid_number(F.col("p_brand")).alias("digits"))


# -- embeddings
def _vectors(t):
    e = t("embeddings")
    active = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("record_id"), F.lit("m2").alias("model"), F.lit(2).alias("version"))
    return active.unionByName(e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("record_id"), F.lit("m1").alias("model"), F.lit(1).alias("version")))


@query("emb_1_missing", "SELECT vec_id AS record_id FROM embeddings WHERE vec_id % 4 = 0")
def _(t):
    return embed.missing_embeddings(t("embeddings").select(F.col("vec_id").alias("record_id")), _vectors(t), "m2", 2)


@query("emb_2_worklist", "SELECT vec_id AS record_id FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 10 = 1")
def _(t):
    r = t("embeddings").select(F.col("vec_id").alias("record_id"))
    return embed.embedding_worklist(r.where("record_id % 10 = 1"), embed.missing_embeddings(r, _vectors(t), "m2", 2))


@query("emb_5_purge", "SELECT vec_id AS record_id, 'm2' AS model FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, 'm1' FROM embeddings WHERE vec_id % 12 = 0")
def _(t):
    return embed.purge_stale(_vectors(t), "m2", 2).select("record_id", "model")


@query("emb_6_coverage", "SELECT label, count(*) AS records, count(*) FILTER (vec_id % 4 <> 0) AS vectors FROM embeddings GROUP BY 1")
def _(t):
    return embed.embedding_coverage(t("embeddings").select(F.col("vec_id").alias("record_id"), "label"), _vectors(t), "m2", 2, "label")


@query("emb_7_cache", "WITH c AS (SELECT DISTINCT sha256('m' || chr(10) || '64' || chr(10) || lower(trim(text, ' '))) AS k FROM conversations WHERE turn % 2 = 0) SELECT conv_id, turn, sha256('m' || chr(10) || '64' || chr(10) || lower(trim(text, ' '))) IN (SELECT k FROM c) AS hit FROM conversations")
def _(t):
    q = t("conversations").withColumn("key", embed.cache_key("m", 64, F.col("text")))
    cache = q.where("turn % 2 = 0").select("key", F.lit(2).alias("expires_at"))
    return embed.cache_lookup(q.select("conv_id", "turn", "key"), cache, F.lit(1)).select("conv_id", "turn", "hit")


@query("emb_9_mock", "SELECT p_partkey, list_transform(range(8), lambda i: round(((ascii(substr(p_name, CAST(i % length(p_name) AS INTEGER) + 1, 1)) + i) % 97) / 97.0, 6))[8] AS last FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(F.element_at(embed.mock_embedding(F.col("p_name"), 8), 8), 6).alias("last"))


# -- filters on part
@query("filt_2_to_7", "SELECT p_partkey, p_brand = 'Brand#12' AS eq, p_brand <> 'Brand#12' AS neq, p_size >= 25 AS cmp, p_type IN ('PROMO', 'ECONOMY') AS isin, contains(lower(p_name), 'e') AND contains(lower(p_name), 'a') AS all_of, contains(lower(p_name), 'x') OR contains(lower(p_name), 'o') AS any_of FROM part")
def _(t):
    c = F.col
    return t("part").select(
        "p_partkey", filters.op_eq(c("p_brand"), "Brand#12").alias("eq"), filters.op_neq(c("p_brand"), "Brand#12").alias("neq"),
        filters.op_cmp(c("p_size").cast("string"), "gte", 25).alias("cmp"), filters.op_in(c("p_type"), ["PROMO", "ECONOMY"]).alias("isin"),
        filters.op_contains_all(c("p_name"), ["E", "a"]).alias("all_of"), filters.op_contains_any(c("p_name"), ["X", "o"]).alias("any_of"),
    )


@query("filt_8_hidden", "WITH h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM h) GROUP BY 1")
def _(t):
    named = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", " n.r. x").otherwise("shown").alias("name"))
    return filters.hide_items(named, "name", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("filt_9_topk", "SELECT query_id, id, rank, round(1 - 0.001 * (rank - 1), 6) AS score FROM (SELECT o_custkey AS query_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 10")
def _(t):
    hits = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return filters.filter_only_topk(hits, "10", [F.desc("o_orderdate"), "id"]).select("query_id", "id", "rank", "score")


# -- search over part; queries are the distinct part names
NAMES = "q AS (SELECT min(p_partkey) AS query_id, p_name AS text FROM part GROUP BY p_name)"
LEX = f"""{NAMES}, ix AS (SELECT id, token, max(weight) AS weight FROM (SELECT p_partkey AS id, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS token, 1.0::DOUBLE AS weight FROM part
UNION ALL SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+'))), 0.5::DOUBLE FROM part) GROUP BY 1, 2),
t AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM q), need AS (SELECT query_id, count(*) AS k FROM t GROUP BY 1),
m AS (SELECT query_id, id, round(sum(weight), 6) AS rank FROM t JOIN ix USING (token) JOIN need USING (query_id) GROUP BY query_id, id, k HAVING count(*) = k)"""


def _names(t):
    return t("part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id")).select("query_id", "text")


def _lexical(t):
    return search.lexical_match(search.token_index(t("part"), "p_partkey", {"p_name": 1.0, "p_type": 0.5}), _names(t))


@query("lex_1_3_4_match", f"WITH {LEX} SELECT * FROM m")
def _(t):
    return _lexical(t)


@query("lex_7_topk", f"WITH {LEX} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS INTEGER) AS place FROM m) WHERE place <= 50")
def _(t):
    return search.topk(_lexical(t), [F.desc("rank"), "id"])


@query("lex_5_trigram", """WITH g AS (SELECT p_name, list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS gs FROM (SELECT DISTINCT p_name FROM part)),
k AS (SELECT min(p_partkey) AS id, p_name FROM part GROUP BY p_name), x AS (SELECT a.p_name AS pa, b.p_name AS pb, len(list_intersect(a.gs, b.gs)) AS n, len(a.gs) AS na, len(b.gs) AS nb FROM g a, g b)
SELECT ka.id AS query_id, kb.id AS id, round(n / (na + nb - n), 6) AS similarity FROM x JOIN k ka ON pa = ka.p_name JOIN k kb ON pb = kb.p_name WHERE n / (na + nb - n) > 0.3""")
def _(t):
    n = _names(t)
    return search.trigram_join(n, n.withColumnRenamed("query_id", "id"))


@query("lex_6_exact", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS signal FROM part")
def _(t):
    return t("part").select("p_partkey", search.exact_signal(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))).alias("signal"))


@query("lex_9_identifier", "SELECT s.s_suppkey AS query_id, c.c_custkey AS id FROM supplier s JOIN customer c ON regexp_replace(s.s_name, '[^0-9]', '', 'g') = regexp_replace(c.c_name, '[^0-9]', '', 'g')")
def _(t):
    q = t("supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("id-"), F.regexp_replace("s_name", "[^0-9]", "")).alias("code"))
    return search.identifier_lookup(q, t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("ID "), F.regexp_replace("c_name", "[^0-9]", "")).alias("code")))


VEC = "SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


@query("vec_1_distance", f"SELECT query_id, id, distance FROM ({VEC})")
def _(t):
    e = t("embeddings")
    asked = e.where("vec_id % 20 = 0")  # a stated query set, against all rows
    return search.distances(asked.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"))


@query("vec_2_3_knn", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS place FROM ({VEC})) WHERE place <= 10")
def _(t):
    e = t("embeddings")
    return search.knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 10)


RANKED = "r AS (SELECT o_custkey AS query_id, o_orderkey % 50 AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, 1.0::DOUBLE AS weight FROM orders)"


def _ranked(t):
    w = Window.partitionBy("query_id").orderBy("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", (F.col("o_orderkey") % 50).alias("id"))
    return rows.select("query_id", "id", F.row_number().over(w).alias("rank"), F.lit(1.0).alias("weight"))


@query("rank_1_rrf", f"WITH {RANKED}, f AS (SELECT query_id, id, round(sum(weight / (60 + rank)), 8) AS score FROM r GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM f")
def _(t):
    return rank.rrf(_ranked(t))


@query("rank_2_fuse", f"""WITH {LEX}, a AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS INTEGER) AS rank, 1.0::DOUBLE AS weight FROM m),
b AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS INTEGER) AS rank, 1.1::DOUBLE AS weight FROM m), f AS (SELECT query_id, id, round(sum(weight / (60 + rank)), 8) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM f""")
def _(t):
    m = _lexical(t)
    lex = search.topk(m, [F.desc("rank"), "id"]).select("query_id", "id", F.col("place").alias("rank"), F.lit(1.0).alias("weight"))
    other = search.topk(m, [F.desc("id")]).select("query_id", "id", F.col("place").alias("rank"), F.lit(1.1).alias("weight"))
    return rank.rrf(lex.unionByName(other))


@query("rank_10_11_rescore", """WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_returnflag AS field, max(l_discount * 5) AS b FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT query_id, id, least(sum(b), 0.75) AS boost, count(*) AS fields FROM p GROUP BY 1, 2), o AS (SELECT query_id, id, round(score * (1 + boost), 6) AS score, fields FROM h JOIN t USING (query_id, id)) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fields DESC, score DESC, id) AS INTEGER) AS place FROM o""")
def _(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("field"), (F.col("l_discount") * 5).alias("boost"), "l_quantity")
    parts = parts_of(t("lineitem"))
    li = spread(li, parts, "query_id", "id")
    return rank.rescore(li.groupBy("query_id", "id").agg(F.max("l_quantity").alias("score")), li.select("query_id", "id", "field", "boost"), parts=parts)


@query("rank_17_finalize", "SELECT query_id, id, CAST(place AS INTEGER) AS place FROM (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 9 = 0) DESC, o_orderkey % 3 DESC, o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_totalprice >= 50000 OR o_orderkey % 9 = 0) WHERE place <= 5")
def _(t):
    k = F.col("o_orderkey")
    hits = t("orders").select(F.col("o_custkey").alias("query_id"), k.alias("id"), F.col("o_totalprice").alias("relevance"), F.col("o_totalprice").alias("score"), (k % 9 == 0).alias("identifier"), (k % 3).alias("exact"))
    return rank.finalize(hits, 50000, 5).select("query_id", "id", "place")


@query("rank_18_19_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, c AS confidence, c < 0.45 AS weak FROM (SELECT *, round(0.25 * l_discount * 10 + 0.15 * least(l_quantity / 50, 1) + 0.2 * least(l_tax * 20, 1) + 0.25 * 0.5 + 0.15 * 1, 4) AS c FROM (SELECT * REPLACE (least(l_discount, 0.1) AS l_discount) FROM lineitem))")
def _(t):
    c = rank.confidence(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 20, F.lit(0.5), F.lit(1.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c.alias("confidence"), rank.weak(c).alias("weak"))


# -- evals: results are a customer's orders by price, expectations those of high priority
RES = "res AS (SELECT o_custkey AS case_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders), want AS (SELECT o_custkey AS case_id, o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%')"


def _results(t):
    w = Window.partitionBy("case_id").orderBy(F.desc("o_totalprice"), "id")
    rows = t("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return rows.select("case_id", "id", F.row_number().over(w).alias("rank"))


def _precision(t):
    want = t("orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"))
    return evals.precision_at_k(_results(t), want, t("customer").select(F.col("c_custkey").alias("case_id")), 5)


PREC = f"{RES}, p AS (SELECT c_custkey AS case_id, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h, 0) / least(n, 5) END, 6) AS precision FROM customer LEFT JOIN (SELECT case_id, count(*) AS n FROM want GROUP BY 1) w ON c_custkey = w.case_id LEFT JOIN (SELECT case_id, count(*) AS h FROM res SEMI JOIN want USING (case_id, id) WHERE rank <= 5 GROUP BY 1) x ON c_custkey = x.case_id)"


@query("eval_2_precision", f"WITH {PREC} SELECT * FROM p")
def _(t):
    return _precision(t)


@query("eval_4_rank_above", f"WITH {RES} SELECT l.case_id, l.id AS higher, l.id + 1 AS lower, coalesce(l.rank < r.rank, false) AS passed FROM res l LEFT JOIN res r ON l.case_id = r.case_id AND r.id = l.id + 1")
def _(t):
    r = _results(t)
    return evals.rank_above(r, r.select("case_id", F.col("id").alias("higher"), (F.col("id") + 1).alias("lower")))


@query("eval_7_ceiling", "SELECT o_custkey AS case_id, count(*) AS n, count(*) <= 10 AS passed FROM orders GROUP BY 1")
def _(t):
    return evals.ceilings(_results(t), 10)


@query("eval_9_metrics", f"WITH {PREC} SELECT case_id % 7 AS run_id, round(avg(CASE WHEN precision = 1 THEN 1.0 ELSE 0.0 END), 6) AS score, count(*) AS cases, round(avg(precision), 6) AS precision, quantile_disc(c_acctbal, 0.5) AS p50, quantile_disc(c_acctbal, 0.95) AS p95 FROM p JOIN customer ON case_id = c_custkey GROUP BY 1")
def _(t):
    v = _precision(t).join(t("customer"), F.col("case_id") == F.col("c_custkey"))
    return evals.run_metrics(v.select((F.col("case_id") % 7).alias("run_id"), (F.col("precision") == 1).alias("passed"), "precision", F.col("c_acctbal").alias("latency")))


# -- logs: events, with value as latency
@query("ops_1_logs", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 9)) ORDER BY ts DESC, event_id DESC LIMIT 51")
def _(t):
    return ops.list_logs(t("events"), F.col("event_type") == "error", "ts", "event_id", 50, ("2024-01-20 00:00:00", 9)).select("event_id", "ts")


@query("ops_2_stats", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(t):
    return ops.query_stats(t("events"), ["user_id"], "value", F.col("event_type") == "error")


@query("ops_3_5_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return ops.status_counts(t("orders"), "o_orderstatus", "o_orderpriority")


@query("ops_6_illegal_steps", "SELECT user_id, event_id, before, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND NOT (before = 'view' OR (before = 'click' AND event_type IN ('purchase', 'view')))")
def _(t):
    e = t("events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    states = e.select("state").distinct()
    allowed = states.select(F.lit("view").alias("from_state"), F.col("state").alias("to_state")).unionByName(
        states.where("state in ('purchase', 'view')").select(F.lit("click").alias("from_state"), F.col("state").alias("to_state")))
    return ops.illegal_steps(e, allowed, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "before", "state")


@query("ops_6_current_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS steps FROM events GROUP BY 1")
def _(t):
    return ops.current_state(t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("state")), "user_id", ["ts", "event_id"])


@query("ops_7_versions", "SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'O') AS active, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def _(t):
    v = t("orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"))
    return ops.active_version(v, "o_custkey")


@query("str_6_windows", """WITH s AS (SELECT *, unnest([0, 15, 30, 45]) AS back FROM events), w AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts) - to_minutes(back) AS start FROM s)
SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM w GROUP BY 1""")
def _(t):
    return rolling_metrics(t("events"), "ts", "value", F.col("event_type") == "error")


def hybrid_search(t) -> DataFrame:
    """The minimum slice: queries are the distinct part names with a price ceiling; words and
    deterministic test vectors are fused, the top ten of each query are kept."""
    parts = t("part")
    names = parts.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"), F.round(F.avg("p_retailprice"), 2).alias("most")).select("query_id", "text", "most")
    index = search.token_index(parts, "p_partkey", {"p_name": 1.0, "p_type": 0.5})
    hits = search.lexical_match(index, names).join(names.select("query_id", "most"), "query_id")
    hits = hits.join(parts.select(F.col("p_partkey").alias("id"), "p_retailprice"), "id").where("p_retailprice <= most")
    lexical = search.topk(hits.select("query_id", "id", "rank"), [F.desc("rank"), "id"]).select("query_id", "id", F.col("place").alias("rank"), F.lit(1.0).alias("weight"))
    near = search.knn(
        names.select("query_id", embed.mock_embedding(F.col("text"), 16).alias("embedding")),
        parts.select(F.col("p_partkey").alias("id"), embed.mock_embedding(F.col("p_name"), 16).alias("embedding")), 50,
    ).select("query_id", "id", F.col("place").alias("rank"), F.lit(1.1).alias("weight"))
    return rank.rrf(lexical.unionByName(near)).where("place <= 10")


QUERIES["flagship_hybrid_search"] = lambda spark, d: hybrid_search(lambda name: read_table(spark, d, name))
