"""RAW: change capture on a store of source rows, keyed and compared by hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_hash(*cols: str) -> Column:
    """RAW-1: sha256 of the columns as JSON in name order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def canonical_json(c: Column) -> Column:
    """RAW-1, nested form: JSON text with the keys of every level sorted; null stays null."""

    @F.pandas_udf("string")
    def canonical(text: pd.Series) -> pd.Series:
        return text.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")

    return canonical(c)


def source_record_id(table: str, *keys: str) -> Column:
    """RAW-2: table and key values, joined by colons."""
    return F.concat_ws(":", F.lit(table), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def split_record_id(c: Column) -> tuple[Column, Column]:
    """RAW-3: (table, external id), cut at the first colon; without one the table is csv."""
    at = F.instr(c, ":")
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.lit("csv")), F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)


def csv_record_id(id_: Column, sku: Column, hash_: Column) -> Column:
    """RAW-4: the id, else sku and 16 digits of the hash, else row and these."""
    digits = F.substring(hash_, 1, 16)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(id_), F.concat_ws(":", F.coalesce(blank(sku), F.lit("row")), digits))


def diff_by_hash(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """RAW-5: incoming rows with state new, changed or unchanged; column hash on both sides."""
    old = stored.select(*keys, F.col("hash").alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("hash"), "changed").otherwise("unchanged")
    return incoming.join(old, keys, "left").withColumn("state", state).drop("_old")


def count_transitions(incoming: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """RAW-6: per key the number of changes in the batch's order and the last hash."""
    old = stored.select(*keys, F.col("hash").alias("_old"))
    w = Window.partitionBy(*keys).orderBy(order, "hash")
    rows = incoming.join(old, keys, "left").withColumn("_before", F.coalesce(F.lag("hash").over(w), F.col("_old")))
    moved = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("hash")), 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.sum(moved).alias("transitions"), F.max_by("hash", F.struct(order, "hash")).alias("hash"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """RAW-7, MAP-14, EMB-4: stored rows with new and changed ones put in, with all columns of
    the stored rows. Rows that stay keep synced_at, changed ones keep created_at. Incoming
    keys must be unique."""
    s, i = stored.alias("s"), incoming.alias("i")
    on = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in keys]
    joined = s.join(i, on, "full_outer")
    there = F.col("i.hash").isNotNull()
    pick = lambda c: (F.when(there, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")) if c in incoming.columns else F.col(f"s.{c}")).alias(c)
    payload = [c for c in stored.columns if c not in (*keys, "created_at", "synced_at")]
    same = F.col("i.hash").isNull() | F.coalesce(F.col("i.hash") == F.col("s.hash"), F.lit(False))
    return joined.select(
        *[pick(c) for c in (*keys, *payload)], F.coalesce("s.created_at", now).alias("created_at"),
        F.when(same, F.col("s.synced_at")).otherwise(now).alias("synced_at"),
    )


def remove_stale_by_table(stored: DataFrame, seen: DataFrame, tables: DataFrame) -> DataFrame:
    """RAW-8: without rows of a synced table whose key wasn't seen."""
    synced, kept = tables.select("table").distinct().withColumn("_synced", F.lit(True)), seen.select("table", "id").distinct().withColumn("_seen", F.lit(True))
    marked = stored.join(synced, "table", "left").join(kept, ["table", "id"], "left")
    return marked.where("_synced is null or _seen is not null").select(*stored.columns)


def remove_stale(stored: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """RAW-9: without rows whose key wasn't seen."""
    return stored.join(seen.select(*keys).distinct(), keys, "left_semi")


def remove_stale_by_prefix(stored: DataFrame, prefix: str, seen: DataFrame, key: str) -> DataFrame:
    """RAW-10: as RAW-9, but only for keys with a prefix."""
    marked = stored.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return marked.where(F.col("_seen").isNotNull() | ~F.coalesce(F.col(key).startswith(prefix), F.lit(False))).select(*stored.columns)


def remove_stale_children(stored: DataFrame, live: DataFrame, parent: str, child: list[str], guard: int = 100) -> DataFrame:
    """RAW-11: without children missing from the live list of a refreshed parent; a parent
    with ``guard`` or more live children is left alone, as its list may be cut."""
    refreshed = live.groupBy(parent).agg(F.count("*").alias("_n")).where(F.col("_n") < guard)
    gone = stored.join(refreshed, parent, "left_semi").join(live.select(*child).distinct(), child, "left_anti")
    return stored.join(gone.select(*child).distinct(), child, "left_anti")


def delete_rows(stored: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """RAW-12: without the rows of some keys."""
    return stored.join(ids.select(*keys).distinct(), keys, "left_anti")


def delete_parents(stored: DataFrame, parents: DataFrame, id_: str, payload: str, path: str = "$.productId") -> DataFrame:
    """RAW-13: without some parents (their ids in the same column) and without the rows whose
    payload names one of them; rows with neither id nor parent stay."""
    gone = parents.select(F.col(id_).cast("string").alias("_gone")).distinct()
    rows = stored.withColumn("_parent", F.get_json_object(payload, path)).withColumn("_own", F.col(id_).cast("string"))
    left = rows.join(gone, F.col("_own") == F.col("_gone"), "left_anti").join(gone, F.col("_parent") == F.col("_gone"), "left_anti")
    return left.drop("_parent", "_own")


def classify_tables(catalog: DataFrame) -> DataFrame:
    """RAW-14: role of each table of a column catalog (table, column, is_pk, is_fk)."""
    n = lambda c: F.count_if(c)
    counts = catalog.groupBy("table").agg(
        n(F.col("is_pk")).alias("pk"), n(F.col("is_fk")).alias("fk"), n(~F.col("is_pk") & ~F.col("is_fk")).alias("other"), F.count("*").alias("cols")
    )
    role = (
        F.when((F.col("pk") >= 2) & (F.col("fk") >= 2) & (F.col("other") <= 1), "junction")
        .when(F.lower("table").contains("config"), "config")
        .when((F.col("fk") == 0) & (F.col("cols") <= 4), "lookup").otherwise("entity")
    )
    return counts.select("table", role.alias("role"))
