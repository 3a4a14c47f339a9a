"""MAP-7, 8: labels of related rows; the ways between tables are read from their foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skein.operators.parts import spread

LABELS = ["nombre", "name", "titulo", "title", "descripcion", "description", "sku"]  # fixed values, in order


def row_label(columns: list[str], key: str, label: str | None = None) -> Column:
    """A row's label: the column ``label``, else the first of LABELS that isn't null in this
    row, else the row's key; null where that text is empty."""
    names = [label] if label else [*(c for c in LABELS if c in columns), key]
    return F.nullif(F.coalesce(*[F.col(c).cast("string") for c in names]), F.lit(""))


def first_seen_labels(via: DataFrame, target: DataFrame, source_column: str, target_column: str, target_key: str, label: str | None = None, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(key, labels): for each value of the junction's source column the distinct labels of its
    targets, in the order in which the junction's rows (by ``order``, else by target) show them.

    Rows of the junction shrink to distinct pairs with their first place before they meet the
    targets, and to distinct labels before a list is made, so repeated rows of a popular source
    or target cost their distinct pairs only. Rows without a key or target are left out, as are
    targets with an empty label. ``target_key`` is unique, as what a foreign key points to.
    parts: of the shuffles, see ``parts_of``; a target with very many pairs is then one task's, as
    Spark splits large parts of its own shuffles only.
    """
    place = F.struct(*[F.col(c) for c in [*(order or []), target_column]])
    rows = via.where(F.col(source_column).isNotNull() & F.col(target_column).isNotNull()).select(
        F.col(source_column).cast("string").alias("key"), F.col(target_column).cast("string").alias("_target"), place.alias("_seen"))
    pairs = spread(rows, parts, "key", "_target").groupBy("key", "_target").agg(F.min("_seen").alias("_seen"))
    named = target.select(F.col(target_key).cast("string").alias("_target"), row_label(target.columns, target_key, label).alias("_label")).where("_label is not null")
    met = spread(pairs, parts, "_target").join(spread(named, parts, "_target"), "_target").select("key", "_label", "_seen")
    first = spread(met, parts, "key").groupBy("key", "_label").agg(F.min("_seen").alias("_seen"))
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_seen", "_label"))).alias("l"))
    return lists.select("key", F.col("l._label").alias("labels"))


def relation_labels(source: DataFrame, via: DataFrame, target: DataFrame, source_key: str, source_column: str, target_column: str, target_key: str, label: str | None = None, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """MAP-7: every row of the source with its key, ``labels`` in first-seen order (empty without
    any) and ``search_text``, the labels joined by blanks."""
    lists = first_seen_labels(via, target, source_column, target_column, target_key, label, order, parts)
    out = spread(source.select(source_key, F.col(source_key).cast("string").alias("key")), parts, "key").join(lists, "key", "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return out.select(source_key, labels.alias("labels"), F.array_join(labels, " ").alias("search_text"))


def relation_paths(catalog: DataFrame, entity_table: str, most: int = 10_000) -> list[Row]:
    """MAP-8: the ways (via, source_column, target_column, target_table, target_key) from a table
    over a junction to the table on its other side, in the order of the catalog.

    The catalog has a row per foreign key: (table, role, place, column, referenced_table,
    referenced_column). Of a junction, the first key to the entity's table is the source side
    and the first of its other keys, which may point to the same table, the target side. The
    catalog describes tables, so the ways come to the driver, which joins along them; more
    than ``most`` are an error.
    """
    key = F.struct("place", "column", "referenced_table", "referenced_column")
    keys = catalog.where("role = 'junction'").groupBy("table").agg(F.array_sort(F.collect_set(key)).alias("keys"))
    keys = keys.withColumn("s", F.get(F.filter("keys", lambda k: k["referenced_table"] == entity_table), F.lit(0))).where("s is not null")
    keys = keys.withColumn("t", F.get(F.filter("keys", lambda k: k["place"] != F.col("s.place")), F.lit(0))).where("t is not null")
    ways = keys.orderBy("s.place").select(F.col("table").alias("via"), F.col("s.column").alias("source_column"), F.col("t.column").alias("target_column"), F.col("t.referenced_table").alias("target_table"), F.col("t.referenced_column").alias("target_key"))
    found = ways.take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} junctions of {entity_table}")
    return found


def auto_relation_text(tables: dict[str, DataFrame], catalog: DataFrame, entity_table: str, key: str, order: dict[str, list[str]] | None = None) -> DataFrame:
    """MAP-8: (key, relation_text) of every row of the entity's table: the distinct labels of all
    rows on the other side of its junctions, joined by blanks; an empty text without any.

    Every way of the catalog is two joins on the columns that it names; a junction or target
    that isn't among the tables is passed over. A label that several junctions give stands
    where the first of them has it.
    """
    parts = []
    for n, p in enumerate(relation_paths(catalog, entity_table)):
        if p.via in tables and p.target_table in tables:
            lists = first_seen_labels(tables[p.via], tables[p.target_table], p.source_column, p.target_column, p.target_key, order=(order or {}).get(p.via))
            parts.append(lists.withColumn("n", F.lit(n)))
    rows = tables[entity_table].select(key, F.col(key).cast("string").alias("key"))
    if not parts:
        return rows.select(key, F.lit("").alias("relation_text"))
    by_key = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "labels"))).alias("l"))
    texts = by_key.select("key", F.array_join(F.array_distinct(F.flatten("l.labels")), " ").alias("relation_text"))
    return rows.join(texts, "key", "left").select(key, F.coalesce("relation_text", F.lit("")).alias("relation_text"))
