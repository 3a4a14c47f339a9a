"""PROF: column profiles over all rows, by unpivot and two-phase aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_counts(raw: DataFrame, table: str) -> DataFrame:
    """PROF-2: rows per table, and the total under a null table."""
    return raw.rollup(table).agg(F.count("*").alias("n"))


def unpivot_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """PROF-3: (column, value as text) for each cell of the named columns."""
    keep = [c for c in columns if not c.startswith("__")]
    return df.select(*[F.col(c).cast("string").alias(c) for c in keep]).unpivot([], keep, "column", "value")


def column_stats(long: DataFrame, most: int = 50) -> DataFrame:
    """PROF-4, 5, 9: nulls, null rate, distinct values, and whether it may be an enum."""
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))  # pre-aggregated: skew on one value is harmless
    found = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"),
    )
    return found.select(
        "column", "rows", "nulls", F.round(F.col("nulls") / F.col("rows"), 6).alias("null_rate"), "distinct",
        ((F.col("distinct") > 0) & (F.col("distinct") <= most)).alias("enum_candidate"),
    )


def top_values(long: DataFrame, k: int = 50) -> DataFrame:
    """PROF-6: the k most frequent values of each column, ties by value."""
    counts = long.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def value_type(c: Column) -> Column:
    """PROF-7: the type that a text value looks like."""
    return (  # fixed values: the patterns
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "datetime")
        .when(c.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^[\[{]"), "json").otherwise("string")
    )


def infer_types(long: DataFrame) -> DataFrame:
    """PROF-7, 8: type of each column (unknown without values or with several types, none of them text), with least and greatest value (numeric for numbers)."""
    typed = long.withColumn("t", F.when(F.col("value").isNotNull(), value_type(F.col("value"))))
    found = typed.groupBy("column").agg(
        F.count_distinct("t").alias("kinds"), F.min("t").alias("one"), F.max((F.col("t") == "string").cast("int")).alias("text"),
        F.min(F.expr("try_cast(value as double)")).alias("min_number"), F.max(F.expr("try_cast(value as double)")).alias("max_number"),
        F.min("value").alias("min_text"), F.max("value").alias("max_text"),
    )
    kind = F.when(F.col("kinds") == 1, F.col("one")).when(F.col("text") == 1, "string").otherwise("unknown")
    dated = F.col("type").isin("date", "datetime")
    return found.withColumn("type", kind).select(
        "column", "type", F.when(F.col("type") == "number", F.col("min_number")).alias("min_number"),
        F.when(F.col("type") == "number", F.col("max_number")).alias("max_number"),
        F.when(dated, F.col("min_text")).alias("min_text"), F.when(dated, F.col("max_text")).alias("max_text"),
    )


def json_shape(df: DataFrame, column: str) -> DataFrame:
    """PROF-10: per key of a JSON object column: type by the rule of PROF-7, rows, distinct
    values and the 20 most frequent ones."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("column", "value"))
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    types = infer_types(counts).select("column", "type")
    top = top_values(pairs, 20).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("r"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct"))
    top = top.select("column", F.transform("r", lambda x: x["value"]).alias("top"))
    return totals.join(types, "column").join(top, "column", "left")


def sample_rows(raw: DataFrame, table: str, order: str, n: int = 10_000) -> DataFrame:
    """PROF-1: the first n rows of each table, which a profile is made of."""
    w = Window.partitionBy(table).orderBy(order)
    return raw.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def parse_stored(c: Column) -> Column:
    """PROF-12: stored text as one of text s, number n and boolean b; the text null is none of them."""
    number = F.when(c.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), c.cast("double"))
    truth = F.when(c == "true", True).when(c == "false", False)
    text = F.when(number.isNull() & truth.isNull() & (c != "null"), c)
    return F.struct(text.alias("s"), number.alias("n"), truth.alias("b"))


def profile_source(columns: DataFrame) -> DataFrame:
    """PROF-13: one JSON document of each source from rows (source, table, column, type, n, nulls)."""
    per_table = columns.groupBy("source", "table").agg(F.sort_array(F.collect_list(F.struct("column", "type", "n", "nulls"))).alias("columns"))
    tables = per_table.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("table", "columns"))).alias("tables"))
    return tables.select("source", F.to_json(F.struct("tables")).alias("profile"))


def atomic_values(df: DataFrame, text: Column, k: int = 50) -> DataFrame:
    """PROF-11: members of comma text: count, top k by count then value, total of distinct ones."""
    members = df.select(F.explode(F.split(text, ",")).alias("value")).select(F.trim("value").alias("value")).where("value <> ''")
    counts = members.groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("total"))
    ranked = counts.orderBy(F.desc("n"), "value").limit(k)
    return ranked.crossJoin(total).withColumn("truncated", F.col("total") > k)  # total is a single row


def _array_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested; those within strings don't count."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"] + F.when(x == "[", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(bare, F.lit(r"([\[\]])")), start, step, lambda s: s["most"])


def atomic_members(long: DataFrame) -> DataFrame:
    """PROF-11: (column, kind, value) for every member of the cells (column, value).

    A JSON array gives its members, arrays in arrays theirs, at any depth; texts are cut at
    commas and trimmed, blank ones, objects and nulls are left out. A cell that isn't JSON is
    comma text itself. Kinds are string, number and boolean, so the number 1 and the text 1
    are two values, while 1, 1.0 and 1e0 are one. The depth is measured first, by one
    aggregate, and gives the number of steps of one expression.
    """
    cells = long.where("value is not null").select("column", "value")
    depth = cells.where(F.col("value").rlike(r"^\s*\[")).agg(F.max(_array_depth(F.col("value")))).first()[0] or 0
    cells = cells.withColumn("v", F.try_parse_json("value"))
    members = F.array("v")
    for _ in range(depth):
        members = F.flatten(F.transform(members, lambda m: F.coalesce(F.try_variant_get(m, "$", "array<variant>"), F.array(m))))
    plain = F.array(F.struct(F.lit("STRING").alias("type"), F.col("value").alias("value")))
    typed = F.transform(members, lambda m: F.struct(F.schema_of_variant(m).alias("type"), m.cast("string").alias("value")))
    leaves = cells.select("column", F.explode(F.when(F.col("v").isNull(), plain).otherwise(typed)).alias("m")).select("column", "m.*")
    kind = F.when(F.col("type") == "STRING", "string").when(F.col("type") == "BOOLEAN", "boolean").when(F.col("type").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
    leaves = leaves.withColumn("kind", kind).where("kind is not null")
    n = F.col("value").try_cast("double")
    number = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(F.col("value"))
    parts = F.when(F.col("kind") == "string", F.split("value", ",")).when(F.col("kind") == "number", F.array(number)).otherwise(F.array("value"))
    return leaves.select("column", "kind", F.explode(parts).alias("value")).withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where("value <> ''")


def atomic_profile(long: DataFrame, columns: list[str] | None = None, k: int = 50) -> DataFrame:
    """PROF-11: (column, suggested, top, cardinality, enum_candidate, truncated) of the members
    of the named columns, else of those that PROF-7 takes for JSON; columns without a member
    have no row. Values stand by count, then value, then kind; top are the first 20.

    Members are counted before they are ranked, so a value that fills a third of the cells
    is one row by then, and only the first k of a task are shuffled for the ranks.
    """
    cells = long.where(F.col("column").isin(columns)) if columns is not None else long.join(infer_types(long).where("type = 'json'").select("column"), "column", "left_semi")
    counts = atomic_members(cells).groupBy("column", "kind", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.count("*").alias("cardinality"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value", "kind")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lists = ranked.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "value", "n"))).alias("l"))
    suggested = F.transform("l", lambda x: x.dropFields("rank"))
    return lists.join(totals, "column").select(
        "column", suggested.alias("suggested"), F.slice(suggested, 1, 20).alias("top"), "cardinality",
        (F.col("cardinality") <= 50).alias("enum_candidate"), (F.col("cardinality") > k).alias("truncated"))


def with_atomic(stats: DataFrame, atomic: DataFrame) -> DataFrame:
    """PROF-11: column statistics (PROF-4, 5, 9) in which the members of a column, where it has
    any, give distinct values and enum flag, with its suggested and top members."""
    found = atomic.select("column", "suggested", "top", "truncated", F.col("cardinality").alias("_n"), F.col("enum_candidate").alias("_enum"))
    return stats.join(found, "column", "left").select(
        "column", "rows", "nulls", "null_rate", F.coalesce("_n", "distinct").alias("distinct"), F.coalesce("_enum", "enum_candidate").alias("enum_candidate"), "suggested", "top", "truncated")


def merge_capabilities(profiles: DataFrame, k: int = 50) -> DataFrame:
    """PROF-14: (entity, field, value, n) of several sources: the larger count of each value, top k."""
    best = profiles.groupBy("entity", "field", "value").agg(F.max("n").alias("n"))
    w = Window.partitionBy("entity", "field").orderBy(F.desc("n"), "value")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def suggest_values(values: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """PROF-15: values of a field that contain the query's text; both have column norm.

    Values are looked up by the query's rarest three letters in a row, by the text itself if
    it is shorter; an empty text finds all values."""
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *(_grams(F.col("norm"), k) for k in (1, 2, 3))))
    index = values.select("field", "value", "norm", F.explode(grams).alias("gram"))
    counts = index.groupBy("field", "gram").agg(F.count("*").alias("n"))
    asked = queries.select("query_id", "field", F.col("norm").alias("q"))
    keys = asked.select("*", F.explode(F.when(F.length("q") >= 3, _grams(F.col("q"), 3)).otherwise(F.array("q"))).alias("gram"))
    rarest = keys.join(counts, ["field", "gram"], "left").groupBy("query_id", "field", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = rarest.join(index, ["field", "gram"]).where(F.contains("norm", "q"))
    w = Window.partitionBy("query_id").orderBy("value")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "value", "rank")
