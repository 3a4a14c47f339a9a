"""The query of pruned hits, counts, flags and confidence: customers ask, their orders are the hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import rank, relevance, verdicts
from skein.plans.registry import query

HITS = """h AS (SELECT o_custkey AS q, o_orderkey AS id, (o_orderkey * 7919 % 1000) / 1000.0 AS rel, (o_orderkey % 4) / 4.0 AS prim, o_orderkey % 29 = 0 AS ident, o_orderkey % 3 AS exact, o_custkey % 5 <> 0 AND o_orderkey % 4 <> 0 AS lex, (o_orderkey % 5) / 4.0 AS cover, CASE WHEN o_custkey % 6 <> 0 THEN o_orderkey % 3 ELSE 0 END AS fields FROM orders),
c AS (SELECT c_custkey AS q, 0.2 + c_custkey % 3 * 0.1 AS mr, 0.25 * (c_custkey % 2) AS mc, 3 + c_custkey % 3 AS lim, c_custkey % 4 AS req, c_custkey % 3 AS app, c_custkey % 7 <> 0 AS free, c_custkey % 11 <> 0 AS hyb, c_custkey % 2 = 0 AS pref FROM customer),
g AS (SELECT h.*, c.* EXCLUDE (q), ident OR rel >= mr AND prim >= mc AS good FROM h JOIN c USING (q)),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ident DESC, exact DESC, rel DESC, id) AS place FROM g WHERE good QUALIFY place <= lim)"""


def _parts(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hits = t("orders").select(
        c.alias("query_id"), k.alias("id"), (k * 7919 % 1000 / 1000).alias("relevance"), (k % 4 / 4).alias("primary_coverage"), (k % 29 == 0).alias("identifier"), (k % 3).alias("exact"),
        ((c % 5 != 0) & (k % 4 != 0)).alias("lexical"), (k % 5 / 4).alias("term_coverage"), F.when(c % 6 != 0, k % 3).otherwise(0).alias("fields"))
    q = F.col("c_custkey")
    tenth = (F.lit(2) + q % 3) / 10
    queries = t("customer").select(
        q.alias("query_id"), tenth.alias("min_relevance"), (q % 2 / 4).alias("min_coverage"), (3 + q % 3).alias("limit"), (q % 4).alias("requested"), (q % 3).alias("applied"),
        (q % 7 != 0).alias("free_text"), (q % 11 != 0).alias("hybrid"), F.when(q % 2 == 0, 1).otherwise(0).alias("preferences"))
    top, counts = verdicts.prune(hits, queries.select("query_id", "min_relevance", "min_coverage", "limit"))
    return hits, queries, top, counts


@query("rank_17_pruned", f"WITH {HITS} SELECT q AS query_id, id, place, 0 AS kept, 0 AS pruned FROM t UNION ALL SELECT q, NULL, NULL, count(*) FILTER (good), count(*) FILTER (NOT good) FROM c LEFT JOIN g USING (q) GROUP BY 1")
def _(t):
    _, _, top, counts = _parts(t)
    zero = F.lit(0).cast("long")
    none = lambda name: F.lit(None).cast("long").alias(name)
    return top.select("query_id", "id", F.col("place").cast("long").alias("place"), zero.alias("kept"), zero.alias("pruned")).unionByName(counts.select("query_id", none("id"), none("place"), "kept", "pruned"))


@query("rank_18_confidence", f"""WITH {HITS}, a AS (SELECT q, max(CASE WHEN place = 1 THEN rel END) AS s1, max(CASE WHEN place = 2 THEN rel END) AS s2, bool_or(place = 1 AND lex) AS l1, max(CASE WHEN place = 1 THEN cover END) AS cov, count(*) AS n FROM t GROUP BY 1), b AS (SELECT q, bool_or(lex) AS anylex, max(fields) AS best FROM h GROUP BY 1),
r AS (SELECT c.*, coalesce(l1, false) AS l, coalesce(cov, 0) AS cv, anylex, pref AND coalesce(best, 1) = 0 AS fallback, least(1, 0.25 * CASE WHEN coalesce(s1, 0) > 0 THEN greatest(0, (CAST(s1 AS DOUBLE) - coalesce(s2, 0)) / s1) ELSE 0 END + 0.15 * CASE WHEN req = 0 THEN 1 ELSE least(1, CAST(app AS DOUBLE) / req) END + 0.2 * CASE WHEN l1 THEN 1 ELSE 0 END + 0.25 * coalesce(cov, 0) + 0.15 * least(1, coalesce(n, 0) / CAST(lim AS DOUBLE))) AS raw FROM c LEFT JOIN a USING (q) LEFT JOIN b USING (q)),
v AS (SELECT q, fallback, CAST(CASE WHEN free AND hyb AND NOT coalesce(anylex, false) AND NOT l AND cv < 0.34 THEN least(round(raw, 4), 0.42) ELSE round(raw, 4) END AS DECIMAL(12, 6)) AS conf FROM r),
w AS (SELECT q, fallback, CAST(CASE WHEN fallback THEN round(conf * 0.5, 4) ELSE conf END AS DOUBLE) AS confidence FROM v) SELECT q AS query_id, fallback AS preference_fallback, confidence, confidence < 0.45 AS weak FROM w""")
def _(t):
    hits, queries, top, _ = _parts(t)
    misses = verdicts.preference_misses(queries, hits)
    out = verdicts.query_confidence(queries, top, hits, misses).join(misses, "query_id")
    return out.select("query_id", "preference_fallback", "confidence", rank.weak(F.col("confidence")).alias("weak"))


@query("rank_7_second_run", """WITH p AS (SELECT p_partkey AS id, p_type || ' ' || p_size AS text, p_brand AS brand, p_size AS size FROM part), q AS (SELECT c_custkey AS q, CASE WHEN c_custkey % 4 = 0 THEN 'narrower ' || text ELSE text END AS text, text AS original, CASE WHEN c_custkey % 2 = 0 THEN 'Brand#1' ELSE 'Brand#2' END AS brand, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS moves, c_custkey % 6 = 0 AS fixed FROM customer JOIN p ON id = c_custkey % 100 + 1),
one AS (SELECT q, id FROM q JOIN p ON p.text = q.text AND p.brand = q.brand AND (NOT fixed OR size > 10)), two AS (SELECT q, id FROM q JOIN p ON p.text = q.original AND (NOT fixed OR size > 10) WHERE moves AND q NOT IN (SELECT q FROM one))
SELECT q AS query_id, false AS relaxed, count(*) AS n, sum(id) AS ids FROM one GROUP BY 1 UNION ALL SELECT q, true, count(*), sum(id) FROM two GROUP BY 1""")
def _(t):
    parts = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_size").alias("words"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    k = F.col("c_custkey")
    asked = t("customer").join(parts, (k % 100 + 1) == F.col("id")).select(k.alias("query_id"), F.when(k % 4 == 0, F.concat(F.lit("narrower "), "words")).otherwise(F.col("words")).alias("text"), F.col("words").alias("original"))
    row = lambda field, op, value, implicit: t("customer").select(k.alias("query_id"), F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value"), implicit.alias("implicit"), (k % 5 == 0).alias("protected"), F.lit(None).cast("double").alias("boost"))
    f = row("brand", "eq", F.when(k % 2 == 0, "Brand#1").otherwise("Brand#2"), k % 3 != 0).unionByName(row("size", "gt", F.lit("10"), F.lit(False)).where("query_id % 6 = 0"))

    def search(queries, filters):
        """The filters are part of the join, so that only hits are made, not what they drop."""
        said = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
        wanted = filters.groupBy("query_id").agg(said("brand").alias("of"), said("size").cast("int").alias("over"))
        rows = queries.select("query_id", "text").join(wanted, "query_id", "left")
        pool, fits = parts.hint("merge"), F.col("over").isNull() | (F.col("size") > F.col("over"))
        one = rows.where("of is not null").join(pool, (F.col("text") == F.col("words")) & (F.col("of") == F.col("brand")) & fits)
        any_ = rows.where("of is null").join(pool, (F.col("text") == F.col("words")) & fits)
        return one.select("query_id", "id").unionByName(any_.select("query_id", "id"))

    hits, _ = relevance.search_relaxed(asked, f, search)
    return hits.groupBy("query_id", "relaxed").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
