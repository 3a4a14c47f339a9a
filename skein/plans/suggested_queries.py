"""The query of filters that a model suggests; the model is a rule, so that SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import suggested
from skein.plans.registry import query


def _model(prompts: list[str]) -> list[str]:
    """Answers by the length of the text: right ones, unknown fields, wrong types, no JSON, a failure."""
    out = []
    for p in prompts:
        text = p.rpartition("Text: ")[2]
        word, k = text.split(" ")[0], len(text) % 7
        if k == 4:
            raise RuntimeError("no model")
        out.append([
            f'```json\n{{"filters": {{"size": {len(text)}, "word": "{word}"}}}}\n```', 'Sure: {"filters": {"ghost": 1, "flag": true}} done', '{"filters": {"size": "big", "flag": true}}',
            "no idea", "", f'{{"filters": {{"tone": "{word}"}}}}', '{"other": 1}',
        ][k])
    return out


@query("nl_9_suggested", """WITH p AS (SELECT p_partkey AS id, p_name AS text, string_split(p_name, ' ')[1] AS word, length(p_name) % 7 AS k, p_partkey % 3 = 0 AS has FROM part WHERE p_partkey % 10 <> 0),
tones AS (SELECT w FROM (SELECT string_split(p_name, ' ')[1] AS w, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, w LIMIT 3)
SELECT id, 'size' AS field, CAST(length(text) AS VARCHAR) AS value FROM p WHERE k = 0 UNION ALL SELECT id, 'word', word FROM p WHERE k = 0 UNION ALL SELECT id, 'flag', 'true' FROM p WHERE k = 1 AND NOT has UNION ALL SELECT id, 'tone', word FROM p WHERE k = 5 AND word IN (SELECT w FROM tones)
UNION ALL SELECT id, 'warning', 'unknown field ghost' FROM p WHERE k = 1 UNION ALL SELECT id, 'warning', 'unknown field flag' FROM p WHERE k IN (1, 2) AND has
UNION ALL SELECT id, 'warning', 'invalid filters' FROM p WHERE k = 2 OR k = 5 AND word NOT IN (SELECT w FROM tones) UNION ALL SELECT id, 'warning', 'no answer' FROM p WHERE k IN (3, 4)""")
def _(t):
    p, c = t("part"), F.col
    texts = p.select(c("p_partkey").alias("query_id"), F.lit("part").alias("entity"), F.when(c("p_partkey") % 10 == 0, "  ").otherwise(c("p_name")).alias("text"))
    used = p.where("p_partkey % 3 = 0").select(c("p_partkey").alias("query_id"), F.lit("flag").alias("field"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind")) for n, k in (("size", "number"), ("flag", "boolean"), ("word", "string"), ("tone", "string"))]))
    fields = texts.select("entity").distinct().select("entity", named.alias("x")).select("entity", "x.*", F.lit("").alias("description"))
    counts = p.groupBy(F.split("p_name", " ")[0].alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(3)
    values = counts.select(F.lit("part").alias("entity"), F.lit("tone").alias("field"), "value", F.lit(1).alias("rank"))
    out = suggested.model_filters(texts, used, suggested.field_lists(fields, values), _model)
    found = out.select(c("query_id").alias("id"), F.explode("filters").alias("f")).select("id", "f.field", "f.value")
    return found.unionByName(out.select(c("query_id").alias("id"), F.lit("warning").alias("field"), F.explode("warnings").alias("value")))
