"""Queries of the LEX and RANK operators on parts of texts and relevance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import branches as B
from skein.operators import relevance as R
from skein.operators.search import token_index
from skein.plans.registry import query

# -- query texts from parts: a name, a brand or a type; the second word of a name has two synonyms
TEXT = "q AS (SELECT p_partkey AS query_id, p_name || ', ' || p_brand || ' or ' || p_type AS text FROM part)"
SYN = "syn AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS term, unnest([upper(string_split(p_name, ' ')[2]) || ' X' || length(p_name), length(p_name) || ' lts']) AS synonym FROM part)"
PARTS = rf"""{TEXT}, {SYN},
seg AS (SELECT query_id, text AS whole, trim(unnest(regexp_split_to_array(text, '[,;|/]+'))) AS text FROM q),
raw AS (SELECT query_id, text, 'full' AS kind, 1.0 AS weight FROM q
UNION ALL SELECT query_id, text, 'phrase', 1.15 FROM seg WHERE lower(text) <> lower(whole)
UNION ALL SELECT query_id, synonym, 'synonym', 1.25 FROM q JOIN syn ON contains(lower(text), lower(term))
UNION ALL SELECT query_id, trim(unnest(regexp_split_to_array(text, '\s+(?:o|ó|or)\s+'))), 'distinctive', 1.5 FROM (SELECT query_id, text FROM seg UNION ALL FROM q) WHERE regexp_matches(text, '\s(o|ó|or)\s')
UNION ALL SELECT query_id, w, 'distinctive', 1.5 FROM (SELECT query_id, unnest(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9''-]*')) AS w FROM q) WHERE lower(w) <> 'tipo' AND lower(w) <> 'or' AND length(w) >= CASE WHEN w BETWEEN 'A' AND 'Zz' THEN 3 ELSE 5 END),
best AS (SELECT query_id, lower(text) AS norm, min((-weight, text, kind)) AS b FROM raw WHERE text <> '' GROUP BY 1, 2),
parts AS (SELECT query_id, b[2] AS text, b[3] AS kind, CAST(-b[1] AS DOUBLE) AS weight FROM best)"""


def _texts(t):
    return t("part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(" or "), "p_type").alias("text"))


def _synonyms(t):
    w, n = F.element_at(F.split("p_name", " "), 2), F.length("p_name")
    return t("part").select(w.alias("term"), F.explode(F.array(F.concat(F.upper(w), F.lit(" X"), n), F.concat(n, F.lit(" lts")))).alias("synonym")).distinct()


@query("lex_2_terms", r"""WITH a AS (SELECT p_partkey AS query_id, unnest([0, 1]) AS alt, unnest(['"' || p_name || '" -' || lower(p_type), lower(p_brand)]) AS part FROM part)
SELECT query_id, CAST(alt AS INTEGER) AS alt, CASE WHEN r LIKE '-%' THEN 'excluded' WHEN r LIKE '"%' THEN 'phrase' ELSE 'word' END AS kind, trim(replace(regexp_replace(r, '^-', ''), '"', '')) AS term FROM (SELECT query_id, alt, unnest(regexp_extract_all(part, '-?"[^"]*"|[^\s"]+')) AS r FROM a)""")
def _(t):
    text = F.concat(F.lit('"'), "p_name", F.lit('" -'), F.lower("p_type"), F.lit(" OR "), "p_brand")
    return B.query_terms(t("part").select(F.col("p_partkey").alias("query_id"), text.alias("text")))


@query("lex_8_identifier", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'C-' || (1000 + c_custkey) WHEN 1 THEN 'A' || (1000 + c_custkey) || '.x' ELSE NULL END AS code FROM customer")
def _(t):
    k = F.col("c_custkey")
    n = (1000 + k).cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("busco código: C-"), n, F.lit("."))).when(k % 5 == 1, F.concat(F.lit(" A"), n, F.lit(".x "))).when(k % 5 == 2, F.concat(F.lit("modelo "), n, F.lit(" rojo"))).when(k % 5 == 3, F.lit("ref ab"))
    return t("customer").select("c_custkey", B.explicit_identifier(text).alias("code"))


@query("lex_10_prepend", """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders),
b AS (SELECT query_id, id, min((tier, place)) AS b FROM (SELECT query_id, id, 1 AS tier, place FROM h UNION ALL SELECT o_custkey, o_orderkey, 0, 0 FROM orders WHERE o_orderkey % 9 = 0) GROUP BY 1, 2)
SELECT query_id, id, b[1] = 0 AS identifier, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, id) AS place FROM b) WHERE place <= 10""")
def _(t):
    rows = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    hits = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "id")))
    return B.prepend_identifiers(rows.where("id % 9 = 0"), hits, 10)


@query("lex_11_branches", f"WITH {PARTS} SELECT * FROM parts")
def _(t):
    return B.branches(_texts(t), _synonyms(t))


@query("lex_12_select", rf"""WITH {PARTS}, x AS (SELECT *, CASE WHEN kind IN ('full', 'synonym') THEN kind ELSE 'other' END AS c, CASE WHEN kind <> 'synonym' OR text LIKE '%lts' THEN 0 ELSE 3 END AS p FROM parts),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY p DESC, weight DESC, text) AS r, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (c = 'synonym') OVER (PARTITION BY query_id) AS s FROM x)
SELECT query_id, text, kind, weight FROM r WHERE n <= 6 OR c = 'full' OR (c = 'synonym' AND r <= 3) OR (c = 'other' AND r <= 5 - least(3, s))""")
def _(t):
    return B.select_branches(B.branches(_texts(t), _synonyms(t)))


@query("lex_13_multi", """WITH q AS (SELECT s_suppkey AS query_id, p_name || ', ' || p_type AS text FROM supplier JOIN part ON p_partkey = s_suppkey),
parts AS (SELECT query_id, 1.0 AS weight, [lower(string_split(p, ' ')[1]), lower(string_split(p, ' ')[2])] AS words FROM (SELECT query_id, string_split(text, ', ')[1] AS p FROM q) UNION ALL SELECT query_id, 1.5, [lower(string_split(text, ', ')[2])] FROM q),
idx AS (SELECT id, token, max(w) AS w FROM (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token, 1.0 AS w FROM part UNION ALL SELECT p_partkey, lower(p_type), 0.5 FROM part) GROUP BY 1, 2),
m AS (SELECT query_id, weight, id, sum(w) AS score FROM parts, unnest(words) AS u(token) JOIN idx USING (token) GROUP BY query_id, weight, words, id HAVING count(*) = len(words)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, weight ORDER BY score DESC, id) AS rank FROM m),
f AS (SELECT query_id, id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 8) AS score FROM k WHERE rank <= 50 GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place FROM f) WHERE place <= 50""")
def _(t):
    q = t("supplier").join(t("part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), "p_name", "p_type")
    parts = q.select("query_id", F.col("p_name").alias("text"), F.lit(1.0).alias("weight")).unionByName(q.select("query_id", F.col("p_type").alias("text"), F.lit(1.5).alias("weight")))
    return B.lexical_multi(parts, token_index(t("part"), "p_partkey", {"p_name": 1.0, "p_type": 0.5}))


@query("lex_14_effective", """WITH m AS (SELECT DISTINCT p_size % 7 AS source, p_type AS entity, string_split(p_name, ' ')[1] AS term, p_brand AS synonym FROM part), p AS (FROM m WHERE source = 3 AND synonym LIKE '%1%'),
r AS (SELECT * FROM m WHERE (source, entity) NOT IN (SELECT (source, entity) FROM p) UNION ALL FROM p) SELECT entity, term, array_to_string(list_sort(list(DISTINCT synonym)), '|') AS synonyms FROM r GROUP BY 1, 2""")
def _(t):
    m = t("part").select((F.col("p_size") % 7).alias("source"), F.col("p_type").alias("entity"), F.element_at(F.split("p_name", " "), 1).alias("term"), F.col("p_brand").alias("synonym"))
    out = B.effective_synonyms(m, m.where("source = 3 and synonym like '%1%'"))
    return out.withColumn("synonyms", F.array_join("synonyms", "|"))


@query("lex_15_coverage", f"WITH {PARTS}, t AS (SELECT query_id, list(DISTINCT lower(text)) AS terms FROM parts WHERE kind IN ('distinctive', 'synonym') GROUP BY 1) SELECT l_orderkey AS query_id, l_partkey AS id, round(CASE WHEN terms IS NULL THEN 1.0 ELSE len(list_filter(terms, lambda x: contains(lower(p_name || ' ' || p_type), x))) / len(terms) END, 6) AS coverage FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey LEFT JOIN t ON query_id = l_orderkey")
def _(t):
    hits = t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).distinct()
    texts = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return B.distinctive_coverage(B.branches(_texts(t), _synonyms(t)), hits.join(texts.hint("merge"), "id"))


@query("lex_16_violations", """WITH v AS (SELECT CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS term, CASE WHEN p_size % 9 = 0 THEN upper(p_name) ELSE p_brand END AS synonym FROM part)
SELECT term, 'duplicate term' AS reason FROM (SELECT unnest(list(DISTINCT term)) AS term, count(DISTINCT term) AS n FROM v GROUP BY lower(term)) WHERE n > 1
UNION ALL SELECT term, 'self synonym' FROM v GROUP BY term HAVING bool_or(lower(term) = lower(synonym)) UNION ALL SELECT term, 'duplicate synonym' FROM v GROUP BY term HAVING count(*) > count(DISTINCT lower(synonym))
UNION ALL SELECT term, 'too many synonyms' FROM v GROUP BY term HAVING count(*) > 20""")
def _(t):
    name = F.col("p_name")
    term, synonym = F.when(F.col("p_size") % 5 == 0, F.upper(name)).otherwise(name), F.when(F.col("p_size") % 9 == 0, F.upper(name)).otherwise(F.col("p_brand"))
    return B.synonym_violations(t("part").select(term.alias("term"), synonym.alias("synonym")), most=20)


@query("rank_3_4_type_weight", """WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS text FROM customer), l AS (SELECT o_custkey AS query_id, max(CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 0 END) AS c FROM orders GROUP BY 1), v AS (SELECT DISTINCT o_custkey AS query_id FROM orders WHERE o_orderstatus = 'F')
SELECT q.query_id, CASE WHEN text IS NULL THEN 'filter_only' WHEN v.query_id IS NULL THEN 'lexical' ELSE 'hybrid_search' END AS type, CASE WHEN text IS NOT NULL AND l.query_id IS NULL AND v.query_id IS NULL THEN 'no candidates' END AS warning, CASE WHEN c > 0 THEN 1.45 ELSE 1.0 END AS weight FROM q LEFT JOIN l ON q.query_id = l.query_id LEFT JOIN v ON q.query_id = v.query_id""")
def _(t):
    q = t("customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("text"))
    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    cover = o.select("query_id", F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0).alias("coverage"))
    return R.query_type(q, o, o.where("o_orderstatus = 'F'")).join(R.lexical_weight(q, cover), "query_id")


@query("rank_6_cap", "SELECT query_id, id, score, CAST(place AS INTEGER) AS place FROM (SELECT l_suppkey AS query_id, l_partkey AS id, score, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS place FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)) JOIN supplier ON s_suppkey = query_id WHERE place <= greatest(3 * (s_suppkey % 20), 30)")
def _(t):
    hits = t("lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("score"))
    return R.cap(hits, t("supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 20).alias("limit")))


@query("rank_7_relax", """WITH f AS (SELECT c_custkey AS query_id, 'segment' AS field, 'eq' AS op, c_mktsegment AS value, c_custkey % 3 <> 0 AS implicit, c_custkey % 5 = 0 AS protected, CASE WHEN c_custkey % 2 = 0 THEN 0.4 END AS boost FROM customer),
e AS (SELECT *, query_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND implicit AND NOT protected AS moves FROM f)
SELECT query_id, field, op, value, CASE WHEN moves THEN coalesce(boost, 0.25) END AS boost, moves FROM e""")
def _(t):
    k = F.col("c_custkey")
    f = t("customer").select(k.alias("query_id"), F.lit("segment").alias("field"), F.lit("eq").alias("op"), F.col("c_mktsegment").alias("value"), (k % 3 != 0).alias("implicit"), (k % 5 == 0).alias("protected"), F.when(k % 2 == 0, 0.4).alias("boost"))
    hits = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query_id"))
    kept, moved = R.relax(f, hits, f)
    return kept.withColumn("boost", F.lit(None).cast("double")).withColumn("moves", F.lit(False)).unionByName(moved.withColumn("moves", F.lit(True)))


@query("rank_8_candidates", """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 1e8 ELSE o_totalprice END AS score FROM orders WHERE o_orderstatus = 'O'),
n AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT n.query_id, n.id, round(0.5 * least(coalesce(s, 0.01), 0.01), 8) AS score FROM n LEFT JOIN (SELECT query_id, min(score) AS s FROM h GROUP BY 1) m ON m.query_id = n.query_id WHERE r <= 50 AND (n.query_id, n.id) NOT IN (SELECT (query_id, id) FROM h)""")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pref"), F.col("o_orderdate").alias("updated_at"), "o_orderstatus", "o_totalprice")
    score = F.when(F.col("query_id") % 2 == 0, F.col("o_totalprice") / 1e8).otherwise(F.col("o_totalprice"))
    hits = o.where("o_orderstatus = 'O'").select("query_id", "id", score.alias("score"))
    return R.preference_candidates(o.select("query_id", "pref", "id", "updated_at"), hits, t("customer").select(F.col("c_custkey").alias("query_id"), F.lit(5).alias("limit")))


@query("rank_9_pref_match", """SELECT p_partkey, op, CASE op WHEN 'eq' THEN string_split(p_name, ' ')[1] = 'red' WHEN 'neq' THEN NOT list_has_any(string_split(p_name, ' '), ['red']) WHEN 'containsAny' THEN list_has_any(string_split(p_name, ' '), ['red', 'bolt']) WHEN 'containsAll' THEN list_has_all(string_split(p_name, ' '), ['red', 'bolt']) ELSE p_size >= 10 END AS matched FROM part, (SELECT unnest(['eq', 'neq', 'containsAny', 'containsAll', 'gte']) AS op)""")
def _(t):
    rows = t("part").select("p_partkey", "p_name", "p_size", F.explode(F.array(*map(F.lit, ["eq", "neq", "containsAny", "containsAll", "gte"]))).alias("op"))
    op = F.col("op")
    have = F.when(op == "gte", F.array(F.col("p_size").cast("string"))).when(op == "eq", F.array(F.element_at(F.split("p_name", " "), 1))).otherwise(F.split("p_name", " "))
    want = F.when(op == "gte", F.array(F.lit("10"))).when(op.startswith("contains"), F.array(F.lit("red"), F.lit("bolt"))).otherwise(F.array(F.lit("red")))
    return rows.select("p_partkey", "op", R.pref_match(have, op, want).alias("matched"))


@query("rank_12_signals", "SELECT l_orderkey AS query_id, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS fields FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def _(t):
    hits = t("lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("query_id"), F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("field"))
    return R.signals(hits.drop("field"), hits).withColumn("fields", F.array_join("fields", ","))


@query("rank_13_sanitize", "SELECT o_custkey AS query_id, o_orderpriority AS field, 'eq' AS op, o_orderstatus AS value, coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN 0.3 END), CASE WHEN o_orderpriority LIKE '2%' THEN 0.2 END, 0.15) AS boost FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1, 2, 4")
def _(t):
    prefs = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("field"), F.lit("eq").alias("op"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, 0.3).alias("boost"))
    f = F.col("field")
    fields = prefs.select("field").distinct().select("field", f.startswith("1").alias("sensitive"), F.lit(True).alias("preferable"), F.when(f.startswith("2"), 0.2).alias("boost"))
    return R.sanitize_prefs(prefs, fields)


# -- concepts and relevance: a supplier asks for a part, its hits are what it has delivered
ASK = "q AS (SELECT s_suppkey AS query_id, p_name || ' de ' || p_type || ' ' || (s_suppkey % 5) || 'lts' AS text FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _asks(t):
    q = t("supplier").join(t("part"), F.col("p_partkey") == F.col("s_suppkey"))
    return q.select(F.col("s_suppkey").alias("query_id"), F.concat("p_name", F.lit(" de "), "p_type", F.lit(" "), F.col("s_suppkey") % 5, F.lit("lts")).alias("text"))


@query("rank_14_concepts", f"""WITH {ASK}, d AS (SELECT p_name AS term, list_sort(list(DISTINCT lower(p_brand))) AS al FROM part WHERE p_name LIKE '% bolt' GROUP BY 1),
f AS (SELECT query_id, term, list_prepend(term, al) AS a FROM q JOIN d ON text LIKE term || ' %'),
w AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM q)
SELECT query_id, array_to_string(a, '|') AS alternatives FROM f UNION ALL SELECT query_id, w FROM w WHERE w <> 'de' AND length(w) >= 2 AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = w.query_id AND list_contains(string_split(f.term, ' '), w))""")
def _(t):
    words = t("part").where("p_name like '% bolt'").select(F.col("p_name").alias("term"), F.col("p_brand").alias("alias"))
    return R.concepts(_asks(t), words).withColumn("alternatives", F.array_join("alternatives", "|"))


@query("rank_15_16_relevance", rf"""WITH {ASK}, h AS (SELECT l_suppkey AS query_id, l_partkey AS id, max(l_quantity) AS score, min(sqrt(l_extendedprice)) / 500 AS distance FROM lineitem GROUP BY 1, 2), m AS (SELECT query_id, max(score) AS top FROM h GROUP BY 1),
c AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x <> 'de' AND length(x) >= 2)) AS terms FROM q),
r AS (SELECT h.query_id, id, score / top AS s, distance, terms, string_split(lower(p_name), ' ') AS a, regexp_extract_all(lower(p_brand), '[a-z0-9]+') AS b, [lower(p_type), CAST(p_size % 5 AS VARCHAR), 'lts'] AS c, p_size % 5 <> h.query_id % 5 AS clash FROM h JOIN m USING (query_id) JOIN c USING (query_id) JOIN part ON p_partkey = id),
k AS (SELECT *, list_sum(list_transform(terms, lambda x: CASE WHEN list_contains(a, x) THEN 1.0::DOUBLE WHEN list_contains(b, x) THEN 0.75 WHEN list_contains(c, x) THEN 0.5 ELSE 0 END)) / len(terms) AS cov, len(list_filter(terms, lambda x: list_contains(a, x))) / len(terms) AS prim FROM r)
SELECT query_id, id, round((CASE WHEN clash THEN 0.35::DOUBLE ELSE 1 END) * (0.35::DOUBLE * s + 0.4::DOUBLE * cov + 0.2::DOUBLE * prim + 0.05::DOUBLE * (1 - distance)), 4) AS relevance, round(cov, 4) AS coverage, round(prim, 4) AS "primary", clash AS conflict FROM k""")
def _(t):
    hits = t("lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("score"), (F.min(F.sqrt("l_extendedprice")) / 500).alias("distance"))
    records = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_brand").alias("b"), F.concat("p_type", F.lit(" "), F.col("p_size") % 5, F.lit(" lts")).alias("c"), F.lit(None).cast("string").alias("d"))
    asks = _asks(t)
    none = asks.where("false").select(F.col("text").alias("term"), F.col("text").alias("alias"))
    return R.relevance(hits.withColumn("identifier", F.lit(False)), R.concepts(asks, none), records)
