"""FILT-12, PROF-16, 17, MAP-1, 15: requests and mappings against what is known of the fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Operators allowed for each kind of field.
OPERATORS = {
    "string": ["eq", "neq", "in", "contains", "containsAny", "containsAll"],
    "number": ["eq", "neq", "gt", "gte", "lt", "lte", "in"],
    "boolean": ["eq", "neq"],
    "array": ["eq", "neq", "in", "contains", "containsAny", "containsAll"],
}


def filter_violations(filters: DataFrame, fields: DataFrame) -> DataFrame:
    """FILT-12: the first reason against each filter (query_id, field, op, value), if there is one.

    fields: field, kind, sensitive, visible, filterable, fixed (bound by a default). Values are text.
    """
    allowed = F.lit(False)
    for kind, ops in OPERATORS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("op").isin(ops))
    value = F.trim(F.coalesce("value", F.lit("")))
    reason = (
        F.when(F.col("kind").isNull(), "unknown").when(F.col("sensitive"), "sensitive").when(~F.col("visible"), "invisible")
        .when(F.col("fixed"), "default").when(~F.col("filterable"), "not filterable").when(~allowed, "operator")
        .when(value == "", "empty value").when((F.col("kind") == "number") & value.try_cast("double").isNull(), "wrong type")
        .when((F.col("kind") == "boolean") & ~F.lower(value).isin("true", "false"), "wrong type")
    )
    return filters.join(fields, "field", "left").select("query_id", "field", "op", "value", reason.alias("reason")).where("reason is not null")


def redact_profile(profile: DataFrame, fields: DataFrame) -> DataFrame:
    """PROF-16: profile (table, column, top) with no top values where the column is sensitive."""
    hidden = fields.where("sensitive").select("table", "column").distinct().withColumn("hidden", F.lit(True))
    rows = profile.join(hidden, ["table", "column"], "left")
    return rows.select("table", "column", F.when(F.col("hidden"), F.expr("slice(top, 1, 0)")).otherwise(F.col("top")).alias("top"))


def mapping_violations(refs: DataFrame, profile: DataFrame, compatible: dict[str, list[str]]) -> DataFrame:
    """PROF-17: refs (entity, table, column, kind, use, sensitive) against profile (table, column, type): every
    violation as a row (entity, table, column, use, reason). compatible: types of columns that a kind takes."""
    tables = profile.select("table").distinct().withColumn("known", F.lit(True))
    rows = refs.join(tables, "table", "left").join(profile.select("table", "column", "type"), ["table", "column"], "left")
    fits = F.lit(False)
    for kind, types in compatible.items():
        fits = fits | ((F.col("kind") == kind) & F.col("type").isin(types))
    reasons = F.array_compact(F.array(
        F.when(F.col("known").isNull(), F.lit("unknown table")), F.when(F.col("known") & F.col("type").isNull(), F.lit("unknown column")),
        F.when((F.col("use") == "template") & F.col("sensitive"), F.lit("sensitive in template")),
        F.when(F.col("type").isNotNull() & F.col("kind").isNotNull() & ~fits, F.lit("incompatible type"))))
    return rows.select("entity", "table", "column", "use", F.explode(reasons).alias("reason"))


def route_entities(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """MAP-1: rows (table, ...) to the entity of least place among those of their table (mapping: entity, table, place); others go."""
    first = mapping.groupBy("table").agg(F.min_by("entity", F.struct("place", "entity")).alias("entity"))
    return rows.join(first, "table")


def shape_output(records: DataFrame, fields: list[tuple[str, bool, bool]], keep: list[str]) -> DataFrame:
    """MAP-15: ``keep`` and the fields (name, visible, sensitive) that are visible and not sensitive."""
    shown = [name for name, visible, sensitive in fields if visible and not sensitive and name not in keep]
    return records.select(*keep, *shown)


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
