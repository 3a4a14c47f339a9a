"""Queries of text extraction, sources, nested products, enrichment, job reports and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import embed, extract, filters, mapping, ops, profile, rank, raw, relevance
from skein.plans.registry import query, session_query
from skein.sources import readers
from skein.streaming import streams


def scratch(spark) -> str:
    """A new folder for files that a query writes; shared on a cluster, where it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# -- sources and raw rows
@query("raw_1_nested", """SELECT event_id, sha256('{"a":' || event_id || ',"b":{"x":null,"z":' || json_extract_string(props, '$.k') || '},"é":[2,1]}') AS hash FROM events WHERE props IS NOT NULL""")
def _(t):
    text = F.concat(F.lit('{"é": [2, 1], "b": {"z": '), F.get_json_object("props", "$.k"), F.lit(', "x": null}, "a": '), F.col("event_id"), F.lit("}"))
    return t("events").where("props is not null").select("event_id", F.sha2(raw.canonical_json(text), 256).alias("hash"))


@query("raw_14_roles", """WITH c AS (SELECT * FROM (VALUES ('orders', 4, 1, 1), ('nation', 3, 1, 1), ('region', 2, 1, 0), ('lineitem_part', 5, 2, 2), ('part_supplier', 2, 2, 2), ('app_config', 9, 1, 0)) x(tab, cols, pk, fk))
SELECT CASE WHEN r_regionkey >= 0 THEN tab END AS tab, CASE WHEN pk >= 2 AND fk >= 2 AND greatest(cols - greatest(pk, fk), 0) <= 1 THEN 'junction' WHEN tab LIKE '%config%' THEN 'config' WHEN fk = 0 AND cols <= 4 THEN 'lookup' ELSE 'entity' END AS role, r_regionkey FROM c, region""")
def _(t):
    shapes = [("orders", 4, 1, 1), ("nation", 3, 1, 1), ("region", 2, 1, 0), ("lineitem_part", 5, 2, 2), ("part_supplier", 2, 2, 2), ("app_config", 9, 1, 0)]
    rows = [(n, k, k < pk, k < fk) for n, cols, pk, fk in shapes for k in range(cols)]
    catalog = t("region").sparkSession.createDataFrame(rows, "table string, column int, is_pk boolean, is_fk boolean")
    per_region = t("region").select("r_regionkey", F.explode(F.array(*[F.lit(n) for n, *_ in shapes])).alias("table"))
    return per_region.join(raw.classify_tables(catalog), "table").select(F.col("table").alias("tab"), "role", "r_regionkey")


@query("raw_7_columns", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN NULL ELSE p_name END AS p_name, 1 AS created_at, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 2 ELSE 1 END AS synced_at FROM part")
def _(t):
    hashed = lambda df: df.withColumn("hash", raw.payload_hash("p_name", "p_size"))
    stored = t("part").select("p_partkey", "p_size", "p_name")
    new = stored.where("p_partkey % 2 = 0 and p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") + 1).alias("p_size"), F.lit(None).cast("string").alias("p_name"))
    rows = hashed(stored).withColumns({"created_at": F.lit(1), "synced_at": F.lit(1)})
    return raw.upsert(rows, hashed(new).unionByName(hashed(stored.where("p_partkey % 6 = 0"))), ["p_partkey"], F.lit(2)).drop("hash")


@query("src_1_csv", """SELECT 'up-1' AS source_id, sha256('{"s_suppkey":"' || s_suppkey || '","s_name":"' || s_name || '","note":' || CASE WHEN s_suppkey % 3 = 0 THEN '""' ELSE '"a, \\"b\\""' END || ',"__table":"csv"}') AS hash FROM supplier""")
def _(t):
    rows = t("supplier")
    note = F.when(F.col("s_suppkey") % 3 != 0, F.lit('  a, "b" '))
    path = scratch(rows.sparkSession)
    shown = rows.select("s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("s_name"), note.alias("note"))
    shown.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv_raw(rows.sparkSession, path, "up-1").select("source_id", F.sha2("payload", 256).alias("hash"))


@query("src_7_envelope", """SELECT n_nationkey, n_name, 'nation' AS tab, 'n_regionkey->region.r_regionkey' AS fk, '{"n_nationkey":' || n_nationkey || '}' AS pk, 'lookup' AS role FROM nation""")
def _(t):
    rows = readers.to_raw(t("nation"), "nation", "public", ["n_nationkey"], "lookup", {"n_regionkey": "region.r_regionkey"})
    at = lambda path: F.get_json_object("payload", path)
    return rows.select(
        at("$.n_nationkey").cast("int").alias("n_nationkey"), at("$.n_name").alias("n_name"), at("$.__table").alias("tab"),
        at("$.__foreignKeys[0]").alias("fk"), at("$.__pk").alias("pk"), at("$.__tableRole").alias("role"),
    )


@query("src_8_documents", """SELECT 'eval-' || r_regionkey AS name, 0.8::DOUBLE AS threshold, CAST(place AS INTEGER) AS place, r_name || ' ' || place AS query, 'price' AS field, CAST(place * 10 AS VARCHAR) AS value FROM region, (SELECT unnest([0, 1, 2]) AS place)""")
def _(t):
    region, path = t("region"), scratch(t("region").sparkSession)
    case = lambda k: F.struct(F.concat_ws(" ", "r_name", F.lit(k)).alias("query"), F.array(F.struct(F.lit("price").alias("field"), F.lit("lte").alias("op"), F.lit(k * 10).alias("value"))).alias("mustApplyFilters"))
    region.repartition("r_regionkey").select(F.concat(F.lit("eval-"), "r_regionkey").alias("name"), F.array(*map(case, range(3))).alias("cases")).repartition(5, "name").write.option("maxRecordsPerFile", 1).json(path)
    got = readers.read_documents(region.sparkSession, path)
    return got.select("name", "threshold", "place", "query", F.col("mustApplyFilters")[0]["field"].alias("field"), F.col("mustApplyFilters")[0]["value"].alias("value"))


@query("src_9_store", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS rewritten FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0) GROUP BY 1")
def _(t):
    rows, path = t("orders").select("o_orderkey", "o_orderstatus"), scratch(t("orders").sparkSession)
    readers.write_store(rows.withColumn("version", F.lit(0)), path, ["o_orderstatus"])
    readers.write_store(rows.where("o_orderstatus = 'F' and o_orderkey % 2 = 1").withColumn("version", F.lit(1)), path, ["o_orderstatus"])
    return rows.sparkSession.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("version").cast("long").alias("rewritten"))


# -- profiles and mapping
@query("prof_1_sample", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 100 GROUP BY 1")
def _(t):
    return profile.sample_rows(t("orders"), "o_orderstatus", "o_orderkey", 100).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("prof_7_mixed", """WITH l AS (SELECT 'mixed' AS "column", CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE 'true' END AS value FROM orders UNION ALL SELECT 'texts', CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE 'abc' END FROM orders
UNION ALL SELECT 'none', NULL FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders),
k AS (SELECT "column", CASE WHEN value IS NULL THEN NULL WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN regexp_matches(value, '^-?[0-9.]+$') THEN 'number' WHEN lower(value) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS t FROM l)
SELECT "column", CASE WHEN count(DISTINCT t) = 1 THEN min(t) WHEN count(*) FILTER (t = 'string') > 0 THEN 'string' ELSE 'unknown' END AS type FROM k GROUP BY 1""")
def _(t):
    even = F.col("o_orderkey") % 2 == 0
    o = t("orders").select(F.when(even, "12").otherwise("true").alias("mixed"), F.when(even, "12").otherwise("abc").alias("texts"), F.lit(None).cast("string").alias("none"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return profile.infer_types(profile.unpivot_values(o, o.columns)).select("column", "type")


@query("prof_12_stored", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'null' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN o_orderstatus ELSE 'false' END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v NOT IN ('true', 'false', 'null') AND try_cast(v AS DOUBLE) IS NULL THEN v END AS s, CASE WHEN v NOT IN ('true', 'false', 'null') THEN try_cast(v AS DOUBLE) END AS n, CASE WHEN v IN ('true', 'false') THEN v = 'true' END AS b FROM x""")
def _(t):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, "true").when(k == 1, "null").when(k == 2, F.col("o_custkey").cast("string")).when(k == 3, F.col("o_orderstatus")).otherwise("false")
    return t("orders").select("o_orderkey", profile.parse_stored(v).alias("p")).select("o_orderkey", "p.*")


@query("prof_13_document", """WITH c AS (SELECT o_orderstatus AS source, o_orderpriority AS tab, count(*) AS n, count(*) FILTER (o_custkey % 10 = 0) AS nulls FROM orders GROUP BY 1, 2)
SELECT source, '{"tables":[' || string_agg('{"table":"' || tab || '","columns":[{"column":"o_custkey","type":"number","n":' || n || ',"nulls":' || nulls || '}]}', ',' ORDER BY tab) || ']}' AS profile FROM c GROUP BY 1""")
def _(t):
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("table")).agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 10 == 0).alias("nulls"))
    return profile.profile_source(rows.withColumns({"column": F.lit("o_custkey"), "type": F.lit("number")}))


@query("map_3_project", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS inner_k, event_type AS kind FROM events")
def _(t):
    return t("events").select(*mapping.project_fields({"id": "event_id", "inner_k": "props$.k", "kind": "event_type"})).withColumn("inner_k", F.col("inner_k").cast("int"))


@query("map_12_enrich", "SELECT p_partkey, length(p_name) AS letters, upper(p_name) AS shout, p_partkey % 4 <> 0 AS asked FROM part")
def _(t):
    records = t("part").select(F.col("p_partkey").alias("record_id"), F.sha2("p_name", 256).alias("payload_hash"), "p_name")
    prompt = mapping.render_template("describe {{p_name}}", {"p_name"})
    answer = F.concat(F.lit('{"letters": '), F.length("p_name"), F.lit(', "shout": "'), F.upper("p_name"), F.lit('"}'))
    cache = records.where("record_id % 4 = 0").select("record_id", "payload_hash", F.sha2(prompt, 256).alias("prompt_hash"), answer.alias("output"))
    answers = lambda prompts: ['{"letters": %d, "shout": "%s"}' % (len(p) - 9, p[9:].upper()) for p in prompts]
    got, new = mapping.enrich(records, cache, prompt, answers, "letters long, shout string")
    asked = new.select("record_id", F.lit(True).alias("new"))
    return got.join(asked, "record_id", "left").select(F.col("record_id").alias("p_partkey"), "extra.letters", "extra.shout", F.coalesce("new", F.lit(False)).alias("asked"))


@query("map_16_letters", "SELECT k, lower(strip_accents(chr(CAST(k AS INTEGER)))) AS folded FROM (SELECT DISTINCT 192 + o_orderkey % 192 AS k FROM orders) WHERE k NOT IN (215, 247)")
def _(t):
    k = t("orders").select((192 + F.col("o_orderkey") % 192).alias("k")).distinct().where("k not in (215, 247)")
    return k.select("k", T.normalize_text(F.decode(F.unhex(F.concat(F.hex(192 + F.shiftright("k", 6) - 0), F.hex(128 + F.col("k") % 64))), "UTF-8")).alias("folded"))


def _products(t):
    """Parts as nested products: two variants, options, tags and metafields from their columns."""
    p = t("part")
    field = lambda space, key, value: F.struct(F.lit(space).alias("namespace"), F.lit(key).alias("key"), value.alias("value"))
    variant = lambda k: F.struct((F.col("p_partkey") * 10 + k).alias("id"), F.concat_ws("-", F.lit("sku"), "p_partkey", F.lit(k)).alias("sku"), F.col("p_retailprice").alias("price"), ((F.col("p_size") + k) % 3).alias("quantity"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 10 == 0, "draft").otherwise("active").alias("status"),
        F.concat(F.lit("style:"), F.lower("p_type"), F.lit(", Width = "), "p_size", F.lit(":cm , plain")).alias("tags"),
        F.array(F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("title"))).alias("collections"), F.array(variant(0), variant(1)).alias("variants"),
        F.array(F.struct(F.lit("Main Color").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("style").alias("name"), F.lit("option").alias("value"))).alias("options"),
        F.array(field("a", "fabric", F.col("p_name")), field("b", "fabric", F.col("p_type")), field("a", "weight", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))).alias("product"),
        F.array(field("c", "weight", F.when(F.col("p_size") > 40, F.lit("heavy")))).alias("variant"),
    )


@query("src_6_flatten", """SELECT 'variants' AS kind, p_partkey * 10 + k AS id, p_partkey % 10 <> 0 AND (p_size + k) % 3 > 0 AS available FROM part, (SELECT unnest([0, 1]) AS k)
UNION ALL SELECT 'products', p_partkey, NULL FROM part UNION ALL SELECT 'collections', count(*), NULL FROM (SELECT DISTINCT p_brand, p_type FROM part)""")
def _(t):
    products, variants, collections = mapping.flatten_products(_products(t))
    none = F.lit(None).cast("boolean").alias("available")
    flat = products.select(F.col("__table").alias("kind"), "id", none).unionByName(variants.select(F.col("__table").alias("kind"), "id", "available"))
    return flat.unionByName(collections.groupBy(F.col("__table").alias("kind")).agg(F.count("*").alias("id")).select("kind", "id", none))


@query("map_20_21_attributes", """SELECT p_partkey, p_brand AS color, lower(p_type) AS style, p_size || ':cm' AS width, p_name AS a_fabric, NULL::VARCHAR AS bare_fabric, CASE WHEN p_size > 40 THEN 'heavy' WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS weight, p_brand AS by_suffix, p_partkey % 10 <> 0 AND p_size % 3 > 0 AS available, 3 AS n_tags FROM part""")
def _(t):
    # a small file of many rows is one task; the work on each row is not small
    m = _products(lambda n: t(n).repartition("p_partkey")).select("*", mapping.attribute_map(F.col("options"), F.col("tags"), F.col("product"), F.col("variant")).alias("m"), mapping.variant_columns(F.col("status"), F.col("variants")[0]["quantity"], F.col("tags")).alias("v"))
    at = lambda k: F.element_at("m", k)
    return m.select(
        F.col("id").alias("p_partkey"), at("main_color").alias("color"), at("style").alias("style"), at("width").alias("width"), at("a_fabric").alias("a_fabric"), at("fabric").alias("bare_fabric"),
        at("weight").alias("weight"), mapping.first_attribute(F.col("m"), ["colour", "color"]).alias("by_suffix"), "v.available", F.size("v.tags").alias("n_tags"),
    )


# -- embeddings
@query("emb_3_4_embed", "SELECT p_partkey AS record_id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS made, (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE length(p_name) + length(p_brand) + 1 END)::DOUBLE AS first FROM part")
def _(t):
    records = t("part").select(F.col("p_partkey").alias("record_id"), "p_name", "p_brand")
    stored = records.where("record_id % 3 = 0").select("record_id", F.lit("m").alias("model"), F.lit(1).alias("version"), F.array(F.lit(0.0)).alias("embedding"))
    new = embed.embed_records(records, stored, mapping.render_template("{{p_name}} {{p_brand}}", {"p_name", "p_brand"}), lambda texts: [[float(len(x))] for x in texts], "m", 1)
    key = F.concat_ws(":", "record_id", "model", "version")
    keyed = lambda df: df.withColumn("hash", F.sha2(key, 256))
    whole = raw.upsert(keyed(stored).withColumns({"created_at": F.lit(1), "synced_at": F.lit(1)}), keyed(new), ["record_id", "model", "version"], F.lit(2))
    return whole.select("record_id", F.col("created_at").alias("made"), F.col("embedding")[0].alias("first"))


@query("emb_8_purge", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY >= (SELECT max(ts) FROM events)")
def _(t):
    cache = t("events").select("event_id", (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    now = t("events").agg(F.max("ts").alias("now")).first().now
    return embed.cache_purge(cache, F.lit(now)).select("event_id")


# -- filters, ranking
@query("filt_1_scope", """WITH s AS (SELECT n_nationkey AS source, n_regionkey AS workspace, CASE n_nationkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'indexed' WHEN 2 THEN 'validated' ELSE 'agent_ready' END AS state FROM nation)
SELECT q.r_regionkey AS query_id, c.c_custkey AS id FROM customer c JOIN s ON s.source = c.c_nationkey AND s.state <> 'draft' AND s.source <> 7 JOIN region q ON q.r_regionkey = s.workspace
WHERE (q.r_regionkey % 2 = 0 OR s.source IN (1, 2, 3, 17)) AND (q.r_regionkey < 2 OR c.c_mktsegment = 'BUILDING')""")
def _(t):
    k = F.col("n_nationkey")
    state = F.when(k % 4 == 0, "draft").when(k % 4 == 1, "indexed").when(k % 4 == 2, "validated").otherwise("agent_ready")
    sources = t("nation").select(k.alias("source"), F.col("n_regionkey").alias("workspace"), state.alias("state"), (k != 7).alias("mapped"), F.lit(True).alias("profiled"))
    records = t("customer").join(sources.select("source", "workspace"), F.col("c_nationkey") == F.col("source")).select("workspace", "source", F.col("c_mktsegment").alias("entity"), F.col("c_custkey").alias("id"))
    r = F.col("r_regionkey")
    queries = t("region").select(r.alias("query_id"), r.alias("workspace"), F.when(r % 2 == 1, F.array(*map(F.lit, (1, 2, 3, 17)))).alias("sources"), F.when(r >= 2, "BUILDING").alias("entity"))
    return filters.scope(records, queries, sources)


FILT_LAYERS = "l AS (SELECT o_custkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'stock' ELSE 'color' END AS field, 'eq' AS op, o_orderstatus AS value, o_orderkey AS layer FROM orders WHERE o_custkey % 2 = 0)"


@query("filt_10_merge", f"""WITH {FILT_LAYERS}, d AS (SELECT 'BUILDING' AS entity, 'stock' AS field UNION ALL SELECT 'MACHINERY', 'color' UNION ALL SELECT 'BUILDING', 'hidden'),
f AS (SELECT c_custkey AS query_id, field, 'eq' AS op, 'yes' AS value FROM customer JOIN d ON entity = c_mktsegment)
SELECT query_id, field, op, max_by(value, layer) AS value FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = l.query_id AND f.field = l.field) GROUP BY 1, 2, 3 UNION ALL SELECT * FROM f""")
def _(t):
    k = F.col("o_orderkey") % 3
    layers = t("orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("query_id"), F.when(k == 0, "price").when(k == 1, "stock").otherwise("color").alias("field"), F.lit("eq").alias("op"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("layer"))
    defaults = layers.sparkSession.createDataFrame([("BUILDING", "stock", "eq", "yes"), ("MACHINERY", "color", "eq", "yes"), ("BUILDING", "hidden", "eq", "yes")], "entity string, field string, op string, value string")
    return filters.merge_filters(layers, defaults, t("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("entity")))


@query("filt_11_safe", f"WITH {FILT_LAYERS} SELECT query_id, layer, field, CASE field WHEN 'price' THEN 'sensitive' WHEN 'color' THEN 'unknown' END AS warning FROM l")
def _(t):
    k = F.col("o_orderkey") % 3
    rows = t("orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("query_id"), F.when(k == 0, "price").when(k == 1, "stock").otherwise("color").alias("field"), F.col("o_orderkey").alias("layer"))
    fields = rows.sparkSession.createDataFrame([("price", True, True), ("stock", False, True)], "field string, sensitive boolean, filterable boolean")
    return filters.safe_filters(rows, fields).select("query_id", "layer", "field", "warning")


@query("rank_5_weights", """WITH m AS (SELECT c_nationkey AS source, c_custkey AS place, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS lexical, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal END AS vector, c_acctbal AS least FROM customer),
f AS (SELECT source, min_by(lexical, place) FILTER (lexical IS NOT NULL) AS ml, min_by(vector, place) FILTER (vector IS NOT NULL) AS mv, max(least) AS mt FROM m GROUP BY 1),
p AS (SELECT s_nationkey AS source, max(s_acctbal) AS lexical, max(s_acctbal) AS least FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1)
SELECT f.source, coalesce(p.lexical, ml, 1.0::DOUBLE) AS lexical, coalesce(mv, 1.1::DOUBLE) AS vector, greatest(p.least, mt) AS least FROM f LEFT JOIN p ON p.source = f.source""")
def _(t):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    m = t("customer").select(F.col("c_nationkey").alias("source"), k.alias("place"), F.when(k % 5 == 0, bal).alias("lexical"), F.when(k % 7 == 0, bal).alias("vector"), bal.alias("least"))
    p = t("supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("source")).agg(F.max("s_acctbal").alias("lexical"), F.lit(None).cast("double").alias("vector"), F.max("s_acctbal").alias("least"))
    return relevance.effective_weights(m, p)


@query("rank_2_hybrid", """WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_totalprice AS relevance, o_orderkey % 17 = 0 AS identifier, CAST(o_orderkey % 5 = 0 AS INTEGER) AS exact FROM orders),
v AS (SELECT o_custkey AS query_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS rank, o_orderkey / 10.0 AS distance FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 4 <> 0),
l2 AS (SELECT * FROM l WHERE id % 3 <> 0 OR query_id % 3 = 0), f AS (SELECT query_id, id, round(sum(w), 8) AS s FROM (SELECT query_id, id, 1.0 / (60 + rank) AS w FROM l2 UNION ALL SELECT query_id, id, 1.1 / (60 + rank) FROM v) GROUP BY 1, 2),
j AS (SELECT f.query_id, f.id, CASE WHEN identifier THEN 1.0 WHEN f.query_id NOT IN (SELECT query_id FROM v) THEN relevance ELSE s END AS score, l2.rank AS lexical_rank, distance, coalesce(identifier, false) AS named, coalesce(exact, 0) AS exact, f.query_id NOT IN (SELECT query_id FROM v) AS alone FROM f LEFT JOIN l2 USING (query_id, id) LEFT JOIN v USING (query_id, id))
SELECT query_id, id, score, lexical_rank, distance, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY named DESC, CASE WHEN named OR alone THEN lexical_rank END NULLS FIRST, exact DESC, score DESC, id) AS INTEGER) AS place FROM j) WHERE place <= 10""")
def _(t):
    from pyspark.sql import Window

    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")
    lex = o.select("query_id", "id", by(F.desc("o_totalprice"), "id"), F.col("o_totalprice").alias("relevance"), (F.col("id") % 17 == 0).alias("identifier"), (F.col("id") % 5 == 0).cast("int").alias("exact"))
    vec = o.where("query_id % 3 <> 0 and id % 4 <> 0").select("query_id", "id", by(F.desc("id")), (F.col("id") / 10.0).alias("distance"))
    return rank.fuse(lex.where("id % 3 <> 0 or query_id % 3 = 0"), vec, 10)


# -- filters out of query texts, made from the orders
TEXTS = """q AS (SELECT o_orderkey AS query_id, o_orderpriority AS entity, CASE o_orderkey % 8 WHEN 0 THEN 'Tela ENTRE ' || o_custkey || ' y $' || o_orderkey || ' rojo' WHEN 1 THEN 'algo menos de ' || o_custkey || '.' WHEN 2 THEN 'Más de ' || o_custkey || ',5 disponible' WHEN 3 THEN 'hasta $' || o_custkey || ' sin stock'
WHEN 4 THEN 'mínimo ' || o_custkey || ' agotado' WHEN 5 THEN 'nada que ver 12' WHEN 6 THEN 'over ' || o_custkey || ' under 7' ELSE 'no disponible' END AS text FROM orders),
n AS (SELECT *, lower(strip_accents(text)) AS norm FROM q)"""


def _texts(t):
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey")
    text = (
        F.when(k == 0, F.concat(F.lit("Tela ENTRE "), c, F.lit(" y $"), "o_orderkey", F.lit(" rojo"))).when(k == 1, F.concat(F.lit("algo menos de "), c, F.lit(".")))
        .when(k == 2, F.concat(F.lit("Más de "), c, F.lit(",5 disponible"))).when(k == 3, F.concat(F.lit("hasta $"), c, F.lit(" sin stock"))).when(k == 4, F.concat(F.lit("mínimo "), c, F.lit(" agotado")))
        .when(k == 5, "nada que ver 12").when(k == 6, F.concat(F.lit("over "), c, F.lit(" under 7"))).otherwise("no disponible")
    )
    return t("orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("entity"), text.alias("text"))


@query("nl_1_ranges", f"""WITH {TEXTS}, num AS (SELECT query_id, norm, regexp_extract(norm, 'entre ([0-9]+) y [$]([0-9]+)', 1) AS a, regexp_extract(norm, 'entre ([0-9]+) y [$]([0-9]+)', 2) AS b, regexp_extract(norm, 'menos de ([0-9]+)|under ([0-9]+)', 1) || regexp_extract(norm, 'under ([0-9]+)', 1) AS lt, replace(regexp_extract(norm, 'mas de ([0-9,]+)', 1), ',', '.') AS gt, regexp_extract(norm, 'hasta [$]([0-9]+)', 1) AS lte, regexp_extract(norm, 'minimo ([0-9]+)', 1) AS gte FROM n)
SELECT query_id, 'gte' AS op, least(a::DOUBLE, b::DOUBLE) AS value FROM num WHERE a <> '' UNION ALL SELECT query_id, 'lte', greatest(a::DOUBLE, b::DOUBLE) FROM num WHERE a <> '' UNION ALL
SELECT query_id, CASE WHEN lt <> '' THEN 'lt' WHEN gt <> '' THEN 'gt' WHEN lte <> '' THEN 'lte' ELSE 'gte' END, (CASE WHEN lt <> '' THEN lt WHEN gt <> '' THEN gt WHEN lte <> '' THEN lte ELSE gte END)::DOUBLE FROM num WHERE a = '' AND lt || gt || lte || gte <> ''""")
def _(t):
    return extract.extract_ranges(_texts(t))


@query("nl_2_numeric", """WITH f AS (SELECT p_brand AS entity, p_name AS field, CASE WHEN p_size = 7 THEN 'Precio de venta' WHEN p_size > 30 THEN 'Cost' ELSE 'weight' END AS hints FROM part WHERE p_size % 5 = 2 OR p_size = 31),
n AS (SELECT entity, count(*) AS n, count(*) FILTER (hints <> 'weight') AS h, min(field) AS sole, min(field) FILTER (hints <> 'weight') AS one FROM f GROUP BY 1)
SELECT entity, CASE WHEN h = 1 THEN one WHEN h = 0 AND n = 1 THEN sole END AS field, NOT (h = 1 OR (h = 0 AND n = 1)) AS ambiguous FROM n""")
def _(t):
    hints = F.when(F.col("p_size") == 7, "Precio de venta").when(F.col("p_size") > 30, "Cost").otherwise("weight")
    return extract.numeric_target(t("part").where("p_size % 5 = 2 or p_size = 31").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("field"), hints.alias("hints")))


@query("nl_3_booleans", f"""WITH {TEXTS}, v AS (SELECT query_id, entity, CASE WHEN regexp_matches(norm, 'disponible|en stock|in stock|available|hay stock') THEN true WHEN regexp_matches(norm, 'agotado|sin stock|no disponible|out of stock') THEN false END AS value FROM n)
SELECT query_id, 'f' || left(entity, 1) AS field, value FROM v WHERE value IS NOT NULL AND left(entity, 1) IN ('1', '3')""")
def _(t):
    fields = t("orders").select(F.col("o_orderpriority").alias("entity"), F.concat(F.lit("f"), F.substring("o_orderpriority", 1, 1)).alias("field")).distinct()
    hints = F.when(F.col("field") == "f1", "Disponibilidad").when(F.col("field") == "f3", "in stock").otherwise("colour")
    return extract.extract_booleans(_texts(t), fields.withColumn("hints", hints))


@query("nl_4_6_links", """WITH q AS (SELECT p_partkey AS query_id, ' ' || lower(p_name || ' with ' || p_type) || ' ' AS norm FROM part), v AS (SELECT DISTINCT 'name' AS field, p_name AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part UNION SELECT DISTINCT 'kind', p_type FROM part WHERE p_type LIKE 'P%' UNION SELECT DISTINCT 'name', string_split(p_name, ' ')[1] FROM part),
m AS (SELECT query_id, field, value, instr(norm, ' ' || lower(value) || ' ') AS start, length(value) AS length FROM q JOIN v ON contains(norm, ' ' || lower(value) || ' ')),
k AS (SELECT *, (SELECT count(DISTINCT field) FROM m x WHERE x.query_id = m.query_id AND x.start = m.start AND x.length = m.length) AS fields FROM m)
SELECT query_id, field, max_by(value, length) AS value, false AS ambiguous FROM k WHERE fields = 1 GROUP BY 1, 2 UNION ALL SELECT query_id, field, value, true FROM k WHERE fields > 1""")
def _(t):
    p = t("part")
    queries = p.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(", with "), "p_type").alias("text"))
    one = lambda field, c: p.select(F.lit(field).alias("field"), c.alias("value"))
    values = one("name", F.col("p_name")).union(one("type", F.col("p_type"))).union(one("kind", F.when(F.col("p_type").startswith("P"), F.col("p_type")))).union(one("name", F.split("p_name", " ")[0]))
    kept, ambiguous = extract.select_links(extract.link_values(queries, values.where("value is not null").distinct().withColumn("alias", F.col("value"))))
    return kept.select("query_id", "field", "value", F.lit(False).alias("ambiguous")).unionByName(ambiguous.withColumn("ambiguous", F.lit(True)))


@query("nl_7_route", """SELECT l_orderkey AS query_id, l_linenumber AS link, CASE WHEN l_linenumber = 1 THEN 'filter' WHEN l_returnflag = 'R' THEN 'prefer' WHEN l_returnflag = 'A' THEN 'filter' ELSE 'filter' END AS behaviour, CASE WHEN l_linenumber <> 1 AND l_returnflag = 'R' THEN 0.4::DOUBLE END AS boost, l_partkey FROM lineitem""")
def _(t):
    links = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("link"), F.col("l_returnflag").alias("field"), (F.col("l_linenumber") == 1).alias("explicit"), "l_partkey")
    schema = "field string, behaviour string, boost double"
    fields = links.sparkSession.createDataFrame([("R", "search", 0.4), ("A", "filter", None)], schema)
    policies = links.sparkSession.createDataFrame([("R", "prefer", None)], schema)
    return extract.route_links(links, fields, policies).select("query_id", "link", "behaviour", "boost", "l_partkey")


@query("nl_8_residual", "SELECT p_partkey AS query_id, trim(regexp_replace(substr(p_name, 3, 2) || substr(p_name, 8), '\\s+', ' ', 'g')) AS text FROM part")
def _(t):
    queries = t("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    spans = queries.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("stop")))).alias("s")).select("query_id", "s.*")
    return extract.residual_text(queries, spans)


# -- job reports
JOBS = "j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'retry' ELSE 'completed' END AS state, event_id % 50 AS n_records, ts AS created, ts + to_seconds(event_id % 60) AS started, ts + to_seconds(event_id % 60 + event_id % 7) AS finished, user_id % 9 AS source, user_id % 3 AS workspace, event_id % 2 AS version FROM events)"


def _jobs(t):
    k = F.col("event_id")
    state = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "active").when(k % 5 == 2, "retry").otherwise("completed")
    return t("events").select(
        state.alias("state"), (k % 50).alias("n_records"), F.col("ts").alias("created"), (F.col("ts") + F.make_interval(secs=k % 60)).alias("started"), (F.col("ts") + F.make_interval(secs=k % 60 + k % 7)).alias("finished"),
        (F.col("user_id") % 9).alias("source"), (F.col("user_id") % 3).alias("workspace"), (k % 2).alias("version"),
    )


@query("ops_4_ingest", f"""WITH {JOBS}, e AS (SELECT max(ts) AS t FROM events), d AS (SELECT *, state = 'completed' AND finished > t - INTERVAL 60 MINUTE AS hour, state = 'completed' AND finished > t - INTERVAL 15 MINUTE AS quarter, state IN ('pending', 'retry') AS waits FROM j, e)
SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'retry') AS retry, CAST(coalesce(sum(n_records) FILTER (waits), 0) AS BIGINT) AS pending_records, min(created) FILTER (waits) AS oldest,
CAST(coalesce(sum(n_records) FILTER (quarter), 0) AS BIGINT) AS records_15, CAST(coalesce(sum(n_records) FILTER (hour), 0) AS BIGINT) AS records_60, round(quantile_cont(epoch_ms(finished - started) / 1000.0, 0.5) FILTER (hour), 6) AS p50, round(quantile_cont(epoch_ms(finished - started) / 1000.0, 0.95) FILTER (hour), 6) AS p95 FROM d""")
def _(t):
    return ops.ingest_stats(_jobs(t), F.lit(t("events").agg(F.max("ts").alias("now")).first().now))


@query("ops_8_backfills", f"WITH {JOBS} SELECT DISTINCT source, workspace, version FROM j WHERE state <> 'completed'")
def _(t):
    return ops.pending_backfills(_jobs(t))


@query("ops_9_log", """SELECT o.o_orderkey AS query_id, o.o_orderpriority AS kind, count(l.l_orderkey) AS n_results, max(l.l_extendedprice) AS confidence, coalesce(string_agg(DISTINCT 'flag ' || l.l_returnflag, '; ' ORDER BY 'flag ' || l.l_returnflag) FILTER (l.l_returnflag <> 'N'), '') AS warnings FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""")
def _(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_extendedprice").alias("score"), "l_returnflag")
    warnings = li.where("l_returnflag <> 'N'").select("query_id", F.concat(F.lit("flag "), "l_returnflag").alias("warning"))
    return ops.log_rows(t("orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("kind")), li, warnings)


# -- streams, over a file source, all that is there now
def _stream(spark, sf_dir: str, table: str):
    schema = readers.read_table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


@session_query("str_1_dedupe", "SELECT event_id, event_type, user_id FROM events")
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    twice = events.withColumn("ts", F.col("ts").cast("timestamp")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    path = scratch(spark)
    streams.log_stream(streams.dedupe_events(twice, ["event_id"], "ts"), path + "/out", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/out").select("event_id", "event_type", "user_id")


@session_query("str_7_log", "SELECT event_id, ts, value FROM events WHERE event_type <> 'view'")
def _(spark, sf_dir):
    path = scratch(spark)
    for _ in range(2):  # the second run finds nothing new
        streams.log_stream(_stream(spark, sf_dir, "events").where("event_type <> 'view'"), path + "/out", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/out").select("event_id", "ts", "value")
