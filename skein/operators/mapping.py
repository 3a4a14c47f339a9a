"""MAP: from source rows to searchable records."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import attribute_key, to_string_array


def apply_rule(conditions: list[tuple[str, str, object]]) -> Column:
    """MAP-6: AND of (column, op, value); numeric comparisons of other text are false, as is null."""
    out = F.lit(True)
    for column, op, value in conditions:
        n = F.col(column).try_cast("double") if op in ("gt", "gte", "lt", "lte") else F.col(column).cast("string")
        v = float(value) if op in ("gt", "gte", "lt", "lte") else str(value)
        test = {"gt": n > v, "gte": n >= v, "lt": n < v, "lte": n <= v, "eq": n == v, "neq": n != v}[op]
        out = out & F.coalesce(test, F.lit(False))
    return out


def relation_aggregate(source: DataFrame, via: DataFrame, target: DataFrame, source_key: str, target_key: str, label: str) -> DataFrame:
    """MAP-7: for each source key the sorted distinct labels of its targets.

    Distinct pairs are formed before the join, so a popular target or a source row with
    a long junction list costs its distinct pairs only.
    """
    pairs = via.select(source_key, target_key).distinct()
    named = pairs.join(target.select(target_key, F.col(label).alias("_label")), target_key)
    lists = named.groupBy(source_key).agg(F.array_sort(F.collect_set("_label")).alias("labels"))
    return source.select(source_key).join(lists, source_key, "left").select(source_key, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def search_source(*cols: str) -> Column:
    """MAP-9: the fields in order, joined by blanks; nulls and blanks are left out."""
    return F.trim(F.concat_ws(" ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols]))


def weighted_parts(tiers: dict[str, list[str]]) -> Column:
    """MAP-10: one search text for each weight tier A to D."""
    return F.struct(*[search_source(*tiers.get(t, [])).alias(t) if tiers.get(t) else F.lit("").alias(t) for t in "ABCD"])


def render_template(template: str, allowed: set[str]) -> Column:
    """MAP-11: {{field}} replaced by the column's text, null by nothing; other fields are an error."""
    parts = re.split(r"\{\{\s*([^{}\s]+)\s*\}\}", template)
    if unknown := set(parts[1::2]) - allowed:
        raise ValueError(f"unknown fields in the template: {sorted(unknown)}")
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def project_fields(fields: dict[str, str]) -> list[Column]:
    """MAP-3: columns by their new names; ``column$.a.b`` takes a path out of a JSON column."""
    out = []
    for name, of in fields.items():
        column, mark, path = of.partition("$")
        out.append((F.get_json_object(column, "$" + path) if mark else F.col(column)).alias(name))
    return out


def enrich(records: DataFrame, cache: DataFrame, prompt: Column, provider: Callable[[list[str]], list[str]], schema: str) -> tuple[DataFrame, DataFrame]:
    """MAP-12: records (record_id, payload_hash, ...) with the provider's typed output as column
    ``extra``, and the answers that the cache (record_id, payload_hash, prompt_hash, output)
    lacks. The provider is called for these only."""
    keys = ["record_id", "payload_hash", "prompt_hash"]
    asked = records.withColumn("_prompt", prompt).withColumn("prompt_hash", F.sha2("_prompt", 256))
    missing = asked.join(cache.select(*keys).distinct(), keys, "left_anti").select(*keys, "_prompt").dropDuplicates(keys)

    def run(frames):
        for frame in frames:
            yield frame.drop(columns="_prompt").assign(output=provider(frame["_prompt"].tolist()))

    kinds = ", ".join(f"{k} {asked.schema[k].dataType.simpleString()}" for k in keys)
    new = missing.mapInPandas(run, f"{kinds}, output string")
    known = cache.select(*keys, "output").unionByName(new).dropDuplicates(keys)
    return asked.join(known, keys, "left").select(*records.columns, F.from_json("output", schema).alias("extra")), new


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), which is worked out once, not once for each member of an array."""
    return F.element_at(F.transform(F.array(value), then), 1)


def attribute_map(options: Column, tags: Column, product: Column, variant: Column) -> Column:
    """MAP-20: one map out of options (name, value), tags ``k:v`` or ``k=v``, and metafields
    (namespace, key, value) of product and variant; what stands later wins. A metafield's bare
    key is there only if no other has it."""
    def pairs(rows: Column) -> Column:
        """Entries with a key and a value, the last of each key."""
        good = F.filter(rows, lambda x: (x["k"] != "") & (F.coalesce(x["v"], F.lit("")) != ""))
        return _let(good, lambda g: F.filter(g, lambda x, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda y: y["k"] == x["k"])))

    def entry(k: Column, v: Column) -> Column:
        return F.struct(attribute_key(k).alias("k"), v.alias("v"))

    def metafields(rows: Column) -> Column:
        plain = F.transform(rows, lambda x: entry(x["key"], x["value"]))
        single = _let(plain, lambda p: F.filter(p, lambda x: F.size(F.filter(p, lambda y: y["k"] == x["k"])) == 1))
        return F.concat(F.transform(rows, lambda x: entry(F.concat(x["namespace"], F.lit("."), x["key"]), x["value"])), single)

    none = F.array().cast("array<struct<k: string, v: string>>")
    cut = F.filter(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: x.rlike("[:=]"))
    tagged = F.transform(cut, lambda x: entry(F.regexp_extract(x, "^([^:=]*)[:=]", 1), F.trim(F.regexp_replace(F.regexp_extract(x, "^[^:=]*[:=](.*)$", 1), "=", ":"))))
    parts = [F.transform(options, lambda x: entry(x["name"], x["value"])), tagged, metafields(product), metafields(variant)]
    return F.map_from_entries(pairs(F.concat(*[F.coalesce(p, none) for p in parts])))


def first_attribute(attributes: Column, aliases: list[str]) -> Column:
    """MAP-21: the value of the first alias that is a key, else of the first key that ends in _alias."""
    ends = F.map_values(F.map_filter(attributes, lambda k, v: reduce(or_, [k.endswith(f"_{a}") for a in aliases])))
    return F.coalesce(*[F.element_at(attributes, a) for a in aliases], F.when(F.size(ends) > 0, F.element_at(ends, 1)))


def variant_columns(status: Column, quantity: Column, tags: Column) -> Column:
    """MAP-22: availability and tags as an array."""
    return F.struct(((status == "active") & (quantity > 0)).alias("available"), to_string_array(tags).alias("tags"))


def flatten_products(products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-6: nested products (id, title, status, tags, collections: array<struct<id, title>>,
    variants: array<struct<id, sku, price, quantity>>) as products, variants and collections."""
    flat = products.select(F.lit("products").alias("__table"), "id", "title", "status", to_string_array(F.col("tags")).alias("tags"), F.size("variants").alias("n_variants"))
    variants = products.select(F.col("id").alias("product_id"), "status", F.explode("variants").alias("v"))
    available = (F.col("status") == "active") & (F.col("v.quantity") > 0)
    variants = variants.select(F.lit("variants").alias("__table"), "v.*", "product_id", available.alias("available"))
    collections = products.select(F.explode("collections").alias("c")).select(F.lit("collections").alias("__table"), "c.id", "c.title").distinct()
    return flat, variants, collections


def changed_records(new: DataFrame, stored: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """MAP-13: rows whose compared columns aren't all equal to the stored ones, nulls being equal."""
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in compared], F.lit(True).alias("_there"))
    same = F.col("_there").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(old, keys, "left").where(~same).select(*new.columns)
