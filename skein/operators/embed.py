"""EMB: bookkeeping of one vector per record, model and mapping version."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def missing_embeddings(records: DataFrame, vectors: DataFrame, model: str, version: int) -> DataFrame:
    """EMB-1: records without a vector of the active model and version."""
    active = vectors.where((F.col("model") == model) & (F.col("version") == version))
    return records.join(active.select("record_id"), "record_id", "left_anti")


def embedding_worklist(changed: DataFrame, missing: DataFrame) -> DataFrame:
    """EMB-2: distinct ids of changed and missing records."""
    return changed.select("record_id").union(missing.select("record_id")).distinct()


def purge_stale(vectors: DataFrame, model: str, version: int) -> DataFrame:
    """EMB-5: without other vectors of records that have the active one."""
    active = (F.col("model") == model) & (F.col("version") == version)
    have = vectors.where(active).select("record_id").distinct()
    return vectors.where(active).unionByName(vectors.where(~active).join(have, "record_id", "left_anti"))


def embedding_coverage(records: DataFrame, vectors: DataFrame, model: str, version: int, group: str) -> DataFrame:
    """EMB-6: records and active vectors of each group."""
    active = vectors.where((F.col("model") == model) & (F.col("version") == version)).select("record_id").distinct().withColumn("_v", F.lit(1))
    return records.join(active, "record_id", "left").groupBy(group).agg(F.count("*").alias("records"), F.count("_v").alias("vectors"))


def cache_key(model: str, dims: int, query: Column) -> Column:
    """EMB-7: sha256 of model, dimensions and the normalised query."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(dims)), F.lower(F.trim(query))), 256)


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """EMB-7: queries (key) with whether an unexpired entry exists."""
    live = cache.where(F.col("expires_at") > now).select("key").distinct().withColumn("_hit", F.lit(True))
    return queries.join(live, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_purge(cache: DataFrame, now: Column) -> DataFrame:
    """EMB-8: without expired entries."""
    return cache.where(F.col("expires_at") >= now)


def embed_records(records: DataFrame, stored: DataFrame, text: Column, provider: Callable[[list[str]], list], model: str, version: int, batch: int = 50) -> DataFrame:
    """EMB-3: vectors of the records (record_id) that have none of this model and version;
    the provider gets ``batch`` texts at a time, in the tasks."""
    have = stored.where((F.col("model") == model) & (F.col("version") == version)).select("record_id").distinct()
    todo = records.join(have, "record_id", "left_anti").select("record_id", text.alias("text"))

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame({"record_id": part["record_id"], "embedding": provider(part["text"].fillna("").tolist())})

    kind = records.schema["record_id"].dataType.simpleString()
    found = todo.mapInPandas(run, f"record_id {kind}, embedding array<double>")
    return found.select("record_id", F.lit(model).alias("model"), F.lit(version).alias("version"), "embedding")


def mock_embedding(text: Column, dims: int) -> Column:
    """EMB-9: deterministic test vector: ((code of text[i mod n]) + i) mod 97 / 97."""
    t = F.when(F.length(text) > 0, text).otherwise(F.lit(" "))
    code = lambda i: F.ascii(F.substring(t, (i % F.length(t)) + 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: ((code(i) + i) % 97) / F.lit(97.0))
