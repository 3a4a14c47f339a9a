"""SRC: reading sources, whole or by increments, and writing stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_csv_raw(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """SRC-1: (source_id, payload): all values as trimmed text in JSON; empty lines are skipped; __table is csv."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, inferSchema=False)  # skips empty lines
    texts = [F.coalesce(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("")).alias(c.strip()) for c in rows.columns]
    payload = F.to_json(F.struct(*texts, F.lit("csv").alias("__table")))
    return rows.select(F.lit(source_id).alias("source_id"), payload.alias("payload"))


def to_raw(df: DataFrame, table: str, schema: str, keys: list[str], role: str, foreign: dict[str, str] | None = None) -> DataFrame:
    """SRC-7: rows as one JSON payload with what is known of their table."""
    meta = [
        F.lit(table).alias("__table"), F.lit(schema).alias("__schema"), F.array(*map(F.lit, keys)).alias("__primaryKey"),
        F.to_json(F.struct(*[F.col(k) for k in keys])).alias("__pk"), F.lit(role).alias("__tableRole"),
        F.array(*[F.concat(F.lit(k), F.lit("->"), F.lit(v)) for k, v in sorted((foreign or {}).items())]).cast("array<string>").alias("__foreignKeys"),
    ]
    return df.select(F.to_json(F.struct("*", *meta), {"ignoreNullFields": "false"}).alias("payload"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: eval documents as a row per case, with the case's place; values stay JSON text."""
    case = (
        "query string, expectedExternalIds array<string>, expectedTopIds array<string>, mustNotContainFields array<string>, mustContainFields array<string>,"
        " mustApplyFilters array<struct<field: string, op: string, value: string>>, maxResultCount int, maxConfidence double"
    )
    rows = spark.read.json(path, schema=f"name string, threshold double, cases array<struct<{case}>>", multiLine=True)
    rows = rows.select("name", F.coalesce("threshold", F.lit(0.8)).alias("threshold"), F.posexplode("cases").alias("place", "c"))
    return rows.select("name", "threshold", "place", "c.*")


def read_increment(df: DataFrame, cursor: str, tie: str, after: tuple | None) -> DataFrame:
    """SRC-3: rows after the saved (cursor, key); all rows without one. The predicate reaches the scan."""
    if after is None:
        return df
    c, t = F.lit(after[0]).cast(df.schema[cursor].dataType), F.lit(after[1])
    return df.where((F.col(cursor) >= c) & ((F.col(cursor) > c) | (F.col(tie) > t)))


def next_cursor(df: DataFrame, group: str, cursor: str, tie: str) -> DataFrame:
    """SRC-4: the greatest (cursor, key) of each group."""
    return df.groupBy(group).agg(F.max(F.struct(cursor, tie)).alias("m")).select(group, f"m.{cursor}", f"m.{tie}")


def read_with_overlap(df: DataFrame, time: str, last: str, overlap: str = "5 minutes") -> DataFrame:
    """SRC-5: rows from a little before the last sync on, so late ones aren't lost."""
    return df.where(F.col(time) > F.expr(f"timestamp'{last}' - interval {overlap}"))


def write_store(df: DataFrame, path: str, partitions: list[str]) -> None:
    """SRC-9: replace the partitions that df has, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
