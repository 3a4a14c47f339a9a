"""NL-9: filters that a model suggests for the text that no rule understood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTRUCTION = 'Find structured filters in the text. Answer with JSON only: {"filters": {"field": value}}. Use these fields only:'
FIELD = "array<struct<field: string, kind: string, line: string, allowed: array<string>>>"


def field_lists(fields: DataFrame, values: DataFrame, shown: int = 15, allowed: int = 20) -> DataFrame:
    """(entity, fields): a line of the prompt and the values that are valid for each filterable
    field (entity, field, kind, description), from its known values (entity, field, value, rank).

    Kinds are number, boolean and anything else, which is text; a text field with known values
    takes only its first ``allowed``, one without takes any text."""
    best = values.where((F.col("rank") <= max(shown, allowed)) & F.col("value").isNotNull())
    lists = best.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("l"))
    known = fields.join(lists, ["entity", "field"], "left").withColumn("v", F.coalesce(F.col("l.value"), F.array().cast("array<string>")))
    few = F.array_join(F.slice("v", 1, shown), ", ")
    line = F.concat_ws(" ", F.concat(F.lit("- "), "field", F.lit(" ("), "kind", F.lit(")")), "description", F.when(few != "", F.concat(F.lit("common values: ["), few, F.lit("]"))))
    entry = F.struct("field", "kind", line.alias("line"), F.slice("v", 1, allowed).alias("allowed"))
    return known.groupBy("entity").agg(F.array_sort(F.collect_list(entry)).cast(FIELD).alias("fields"))


def _json_part(text: Column) -> Column:
    """What a fence marks as JSON, else what the outermost braces hold, else all of it."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", F.trim(fenced)).when(braces != "", braces).otherwise(text)


def ask(prompts: DataFrame, provider: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """(prompt, answer): the provider gets ``batch`` prompts at a time, in the tasks. When a batch
    fails its prompts are asked one by one, so one failure (answer null) costs no other."""
    def one(prompt: str):
        try:
            return provider([prompt])[0]
        except Exception:  # whatever the provider raises is the query's warning
            return None

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                texts = part["prompt"].tolist()
                try:
                    answers = list(provider(texts))
                    if len(answers) != len(texts):
                        raise ValueError("an answer for each prompt is needed")
                except Exception:
                    answers = [one(t) for t in texts]
                yield part.assign(answer=answers)

    return prompts.select("prompt").distinct().mapInPandas(run, "prompt string, answer string")


def model_filters(texts: DataFrame, used: DataFrame, fields: DataFrame, provider: Callable[[list[str]], list[str]], instruction: str = INSTRUCTION) -> DataFrame:
    """(query_id, filters, warnings) of every text (query_id, entity, text) that asks the model.

    ``used`` (query_id, field) holds the fields that a query has filters for already, ``fields``
    comes from ``field_lists``. Blank texts and queries without a field left aren't asked and
    have no row; equal prompts are asked once. Filters are (field, op, kind, value), op is eq.
    Fields that weren't offered are dropped with a warning; one value of a wrong type, or not
    among the valid ones, voids all filters of the answer, as does a null; so does an answer
    that isn't JSON or doesn't come, with warnings of their own.
    """
    taken = used.groupBy("query_id").agg(F.collect_set("field").alias("taken"))
    rows = texts.where(F.trim("text") != "").join(fields, "entity").join(taken, "query_id", "left")
    left = F.filter("fields", lambda f: ~F.coalesce(F.array_contains("taken", f["field"]), F.lit(False)))
    rows = rows.withColumn("left", left).where(F.size("left") > 0)
    prompt = F.concat_ws("\n", F.lit(instruction), F.col("left.line"), F.lit(""), F.concat(F.lit("Text: "), "text"))
    rows = rows.select("query_id", "left", prompt.alias("prompt"))
    answers = ask(rows, provider).select("prompt", F.try_parse_json(_json_part(F.col("answer"))).alias("v"))
    rows = rows.join(answers, "prompt").withColumn("given", F.try_variant_get("v", "$.filters", "map<string,variant>"))
    given = F.transform(F.map_entries(F.coalesce("given", F.create_map().cast("map<string,variant>"))), lambda e: F.struct(
        e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("type"), e["value"].cast("string").alias("value"), F.get(F.filter("left", lambda f: f["field"] == e["key"]), F.lit(0)).alias("f")))
    rows = rows.withColumn("given", given)

    def fits(e: Column) -> Column:
        kind, allowed = e["f"]["kind"], e["f"]["allowed"]
        text = (e["type"] == "STRING") & ((F.size(allowed) == 0) | F.array_contains(allowed, e["value"]))
        return F.when(kind == "number", e["type"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")).when(kind == "boolean", e["type"] == "BOOLEAN").otherwise(F.coalesce(text, F.lit(False)))

    offered, strange = F.filter("given", lambda e: e["f"].isNotNull()), F.filter("given", lambda e: e["f"].isNull())
    shape = F.schema_of_variant(F.try_variant_get("v", "$.filters", "variant"))
    answered = F.col("v").isNotNull()
    valid = answered & F.coalesce(shape.rlike("^(OBJECT|VOID)"), F.lit(True)) & F.forall(offered, fits)
    filters = F.transform(offered, lambda e: F.struct(e["field"].alias("field"), F.lit("eq").alias("op"), e["f"]["kind"].alias("kind"), e["value"].alias("value")))
    none = F.array().cast("array<struct<field: string, op: string, kind: string, value: string>>")
    warnings = F.concat(
        F.transform(strange, lambda e: F.concat(F.lit("unknown field "), e["field"])),
        F.when(~answered, F.array(F.lit("no answer"))).when(~valid, F.array(F.lit("invalid filters"))).otherwise(F.array().cast("array<string>")))
    return rows.select("query_id", F.when(valid, filters).otherwise(none).alias("filters"), warnings.alias("warnings"))
