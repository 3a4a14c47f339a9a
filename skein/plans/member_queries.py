"""Queries of the members of JSON arrays and comma text, all columns at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import profile
from skein.plans.registry import query

#: nested arrays, comma text, objects only, one array within another a hundred times over, plain text
CELLS = """cells AS (SELECT 'nested' AS "column", '["' || p_brand || ', ' || p_type || '", [[' || p_size || ', "' || p_size || '"], [' || p_partkey % 7 || '.50, ' || p_size || '.0, true, null, {"x": [1]}]], "  "]' AS value FROM part
UNION ALL SELECT 'commas', CASE WHEN p_partkey % 9 <> 0 THEN replace(p_name, ' ', ' , ,') END FROM part
UNION ALL SELECT 'object', '{"a": [' || p_size || ']}' FROM part
UNION ALL SELECT 'deep', repeat('[', 12) || '"' || p_brand || ' [,]"' || repeat(']', 12) FROM part
UNION ALL SELECT 'plain', p_type FROM part)"""
MEMBERS = f"""WITH RECURSIVE {CELLS}, walk AS (SELECT "column", CAST(value AS JSON) AS v FROM cells WHERE "column" IN ('nested', 'object', 'deep') UNION ALL SELECT "column", unnest(CAST(v AS JSON[])) FROM walk WHERE json_type(v) = 'ARRAY'),
leaves AS (SELECT "column", CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN json_type(v) = 'DOUBLE' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE v ->> '$' END AS value FROM walk WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT', 'NULL')
UNION ALL SELECT "column", 'string', value FROM cells WHERE "column" = 'commas' AND value IS NOT NULL),
members AS (SELECT "column", kind, trim(unnest(CASE WHEN kind = 'string' THEN string_split(value, ',') ELSE [CASE WHEN value LIKE '%.0' THEN replace(value, '.0', '') ELSE value END] END)) AS value FROM leaves),
counts AS (SELECT "column", kind, value, count(*) AS n FROM members WHERE value <> '' GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value, kind) AS rank, count(*) OVER (PARTITION BY "column") AS total FROM counts)"""


def _cells(t):
    p = t("part")
    c = F.col
    nested = F.concat(F.lit('["'), "p_brand", F.lit(", "), "p_type", F.lit('", [['), "p_size", F.lit(', "'), "p_size", F.lit('"], ['), c("p_partkey") % 7, F.lit(".50, "), "p_size", F.lit('.0, true, null, {"x": [1]}]], "  "]'))
    deep = F.concat(F.lit("[" * 12 + '"'), "p_brand", F.lit(' [,]"' + "]" * 12))
    commas = F.when(c("p_partkey") % 9 != 0, F.replace("p_name", F.lit(" "), F.lit(" , ,")))
    wide = p.select(nested.alias("nested"), commas.alias("commas"), F.concat(F.lit('{"a": ['), "p_size", F.lit("]}")).alias("object"), deep.alias("deep"), c("p_type").alias("plain"))
    return profile.unpivot_values(wide, wide.columns)


@query("prof_11_nested", f"""{MEMBERS} SELECT "column", kind, value, n FROM counts""")
def _(t):
    return profile.atomic_members(_cells(t).where("column <> 'plain'")).groupBy("column", "kind", "value").agg(F.count("*").alias("n"))


@query("prof_11_profile", f"""{MEMBERS}, a AS (SELECT "column", total, string_agg(kind || ':' || value || '=' || n, '|' ORDER BY rank) FILTER (rank <= 50) AS suggested, string_agg(value, '|' ORDER BY rank) FILTER (rank <= 20) AS top FROM ranked WHERE "column" IN ('nested', 'deep') GROUP BY 1, 2),
s AS (SELECT "column", count(*) AS rows, count(*) - count(value) AS nulls, round((count(*) - count(value)) / count(*), 6) AS null_rate, count(DISTINCT value) AS d FROM cells GROUP BY 1)
SELECT "column", rows, nulls, null_rate, coalesce(total, d) AS "distinct", coalesce(total, d) BETWEEN 1 AND 50 AS enum_candidate, suggested, top, total > 50 AS truncated FROM s LEFT JOIN a USING ("column")""")
def _(t):
    cells = _cells(t)
    out = profile.with_atomic(profile.column_stats(cells), profile.atomic_profile(cells))
    shown = F.transform("suggested", lambda x: F.concat(x["kind"], F.lit(":"), x["value"], F.lit("="), x["n"]))
    return out.withColumns({"suggested": F.array_join(shown, "|"), "top": F.array_join(F.col("top.value"), "|")})
