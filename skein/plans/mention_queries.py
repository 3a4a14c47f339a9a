"""The query that runs the whole chain from a query text to its filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.extract import understand
from skein.plans.registry import query

# All places (from 1) of a phrase p as whole words in a text t.
_PLACES = "list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(p)) = p AND NOT regexp_matches(substr(' ' || t || ' ', i, 1), '[a-z0-9]') AND NOT regexp_matches(substr(' ' || t || ' ', i + length(p) + 1, 1), '[a-z0-9]'))"


@query("nl_1_8_chain", rf"""WITH q AS (SELECT p_partkey AS query_id, lower(CASE p_partkey % 6 WHEN 0 THEN 'Marca de ' || p_brand || ' y ' || p_type || ' hasta $' || p_size WHEN 1 THEN p_name || ', ' || p_type || ' en stock' WHEN 2 THEN 'tipo ' || left(p_type, 4)
  WHEN 3 THEN 'medida: ' || p_size || ', ' || p_brand WHEN 4 THEN 'entre 5 y ' || p_size || ' ' || p_brand || ' ' || p_brand ELSE 'nada ' || p_name || ' no disponible' END) AS t FROM part),
v AS (SELECT DISTINCT 'brand' AS field, p_brand AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part UNION SELECT DISTINCT 'kind', p_type FROM part WHERE p_type LIKE 'P%' UNION SELECT DISTINCT 'size', p_size || 'cm' FROM part UNION SELECT DISTINCT 'look', string_split(p_name, ' ')[1] FROM part UNION SELECT DISTINCT 'name', p_name FROM part),
h AS (SELECT * FROM (VALUES ('brand', 'marca'), ('type', 'tipo'), ('size', 'medida')) h(field, p)),
imp AS (SELECT query_id, field, value, pl[1] - 1 AS start, pl[1] - 1 + length(value) AS stop, length(value) AS n FROM (SELECT query_id, field, value, {_PLACES} AS pl FROM (SELECT query_id, field, value, t, lower(value) AS p FROM q JOIN v ON contains(t, lower(value)))) WHERE len(pl) > 0),
hp AS (SELECT query_id, field, t, pl[1] - 1 AS b, pl[1] - 1 + length(p) AS e FROM (SELECT *, {_PLACES} AS pl FROM q JOIN h ON contains(t, p)) WHERE len(pl) > 0),
ta AS (SELECT query_id, field, b, e, e + length(raw) - length(tail) AS off, tail, array_to_string(list_filter(regexp_extract_all(tail, '[a-z0-9%.,]+'), lambda x: x NOT IN ('de', 'del', 'la', 'el', 'con', 'en', 'para', 'tipo'))[1:3], ' ') AS said
  FROM (SELECT *, substr(t, e + 1, 80) AS raw, regexp_replace(substr(t, e + 1, 80), '^(?:[\s:\-]|(?:de|del|la|el|con|en)\b)+', '') AS tail FROM hp) WHERE tail <> ''),
c AS (SELECT ta.*, v.value, lower(v.value) AS p, tail AS t, regexp_extract(lower(v.value), '^[0-9]+(?:[.,][0-9]+)?') AS num FROM ta JOIN v USING (field)),
w AS (SELECT *, {_PLACES} AS whole, CASE WHEN length(num) >= 2 THEN {_PLACES.replace("length(p)", "length(num)").replace("= p ", "= num ")} ELSE [] END AS part FROM c),
m AS (SELECT query_id, field, b, e, off, value, CASE WHEN len(whole) > 0 THEN length(p) WHEN len(part) > 0 THEN length(num) ELSE length(said) END AS n, CASE WHEN len(whole) > 0 THEN whole[1] - 1 WHEN len(part) > 0 THEN part[1] - 1 ELSE 0 END AS place
  FROM w WHERE len(whole) > 0 OR len(part) > 0 OR (regexp_matches(said, '[a-z]') AND contains(p, said))),
ex AS (SELECT query_id, field, k[2] AS value, least(b, off + k[3]) AS start, greatest(e, off + k[3] - k[1]) AS stop, -k[1] AS n FROM (SELECT query_id, field, b, e, off, min((-n, value, place)) AS k FROM m GROUP BY ALL)),
op AS (SELECT i.* FROM imp i WHERE NOT EXISTS (FROM ex x WHERE x.query_id = i.query_id AND (x.field = i.field OR (x.start < i.stop AND i.start < x.stop)))),
ok AS (SELECT *, count(*) OVER (PARTITION BY query_id, start, stop, lower(value)) AS fields FROM op),
num AS (SELECT query_id, t, regexp_extract(t, 'hasta [$]([0-9]+)', 1) AS top, regexp_extract(t, 'entre 5 y ([0-9]+)', 1) AS e FROM q),
links AS (SELECT query_id, field, 'eq' AS op, value, start, stop, true AS explicit FROM ex UNION ALL SELECT query_id, field, 'eq', value, start, stop, false FROM ok WHERE fields = 1
  UNION ALL SELECT query_id, 'price', 'lte', top, instr(t, 'hasta') - 1, instr(t, 'hasta') + 6 + length(top), true FROM num WHERE top <> ''
  UNION ALL SELECT query_id, 'price', unnest(['gte', 'lte']), unnest([CAST(least(5, e::INT) AS VARCHAR), CAST(greatest(5, e::INT) AS VARCHAR)]), 0, 10 + length(e), true FROM num WHERE e <> ''
  UNION ALL SELECT query_id, 'available', 'eq', 'true', CASE WHEN contains(t, 'disponible') THEN instr(t, 'disponible') ELSE instr(t, 'en stock') END - 1, CASE WHEN contains(t, 'disponible') THEN instr(t, 'disponible') + 9 ELSE instr(t, 'en stock') + 7 END, true FROM q WHERE contains(t, 'disponible') OR contains(t, 'en stock')),
routed AS (SELECT *, CASE WHEN explicit THEN 'filter' WHEN field IN ('look', 'name') THEN 'prefer' WHEN field = 'type' THEN 'search' ELSE 'filter' END AS behaviour, CASE WHEN NOT explicit AND field IN ('look', 'name') THEN CASE field WHEN 'look' THEN 0.3 ELSE 0.25 END END::DOUBLE AS boost FROM links),
ch AS (SELECT query_id, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS x FROM q),
rest AS (SELECT query_id, string_agg(x, '' ORDER BY i) AS kept FROM ch WHERE NOT EXISTS (FROM routed r WHERE r.query_id = ch.query_id AND r.behaviour <> 'search' AND i - 1 >= r.start AND i - 1 < r.stop) GROUP BY query_id)
SELECT q.query_id, field, op, value, start, stop, explicit, behaviour, boost, trim(regexp_replace(coalesce(kept, ''), '\s+', ' ', 'g')) AS rest FROM q LEFT JOIN routed USING (query_id) LEFT JOIN rest USING (query_id)""")
def _(t):
    """Six forms of texts made of the parts: labels with values, values alone, a part of a
    value, a number that begins one, ranges, availability. One field has no behaviour at all."""
    p = t("part")
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Marca de "), "p_brand", F.lit(" y "), "p_type", F.lit(" hasta $"), "p_size")).when(k == 1, F.concat("p_name", F.lit(", "), "p_type", F.lit(" en stock")))
        .when(k == 2, F.concat(F.lit("tipo "), F.left("p_type", F.lit(4)))).when(k == 3, F.concat(F.lit("medida: "), "p_size", F.lit(", "), "p_brand"))
        .when(k == 4, F.concat(F.lit("entre 5 y "), "p_size", F.lit(" "), "p_brand", F.lit(" "), "p_brand")).otherwise(F.concat(F.lit("nada "), "p_name", F.lit(" no disponible")))
    )
    queries = p.select(F.col("p_partkey").alias("query_id"), F.lit("part").alias("entity"), F.lower(text).alias("text"))
    one = lambda field, c: p.select(F.lit("part").alias("entity"), F.lit(field).alias("field"), c.alias("value"))
    values = one("brand", F.col("p_brand")).union(one("type", F.col("p_type"))).union(one("kind", F.when(F.col("p_type").startswith("P"), F.col("p_type"))))
    values = values.union(one("size", F.concat("p_size", F.lit("cm")))).union(one("look", F.split("p_name", " ")[0])).union(one("name", F.col("p_name")))
    values = values.where("value is not null").groupBy("entity", "field", "value").agg(F.count("*").alias("n"))
    values = values.select("entity", "field", "value", F.when(F.col("n") > 0, F.col("value")).alias("phrase"))  # asked of each value once, not of each row below the grouping
    make = p.sparkSession.createDataFrame
    kinds = [("price", "number", "Precio", "filter", None), ("available", "boolean", "stock", "filter", None), ("brand", "string", "", "filter", None), ("type", "string", "", "search", None), ("kind", "string", "", "filter", None),
             ("size", "string", "", "filter", None), ("look", "string", "", "prefer", 0.3), ("name", "string", "", None, None)]
    fields = make([("part", *f) for f in kinds], "entity string, field string, type string, hints string, behaviour string, boost double")
    hints = make([("part", "brand", "Marca"), ("part", "brand", "brand name"), ("part", "type", "tipo"), ("part", "size", "Medida")], "entity string, field string, phrase string")
    links, rest = understand(queries, fields, hints, values, make([("name", "prefer", None)], "field string, behaviour string, boost double"))
    return queries.select("query_id").join(links.hint("merge"), "query_id", "left").join(rest.withColumnRenamed("text", "rest").hint("merge"), "query_id", "left")
