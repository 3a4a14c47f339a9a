"""EMB-7: the cache of query vectors, with counters and expiry, as a keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import normalize_text

SCHEMA = "key string, embedding array<double>, hit_count long, created_at timestamp, last_used timestamp, expires_at timestamp"


def query_key(model: Column, dims: Column, query: Column) -> Column:
    """sha256 of model, dimensions and the query without accents, in lower case, its white space single blanks."""
    plain = F.trim(F.regexp_replace(normalize_text(query), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\n", model, dims.cast("string"), plain), 256)


def record_hits(cache: DataFrame, lookups: DataFrame, now: Column) -> DataFrame:
    """The cache after lookups (key): each one that finds an entry which isn't expired raises its
    hit_count and sets last_used. Lookups are counted by key first, so a popular query is a row."""
    asked = lookups.where("key is not null").groupBy("key").agg(F.count("*").alias("_asked"))
    rows = cache.join(asked, "key", "left")
    hit = F.col("_asked").isNotNull() & (F.col("expires_at") > now)
    return rows.withColumns({"hit_count": F.col("hit_count") + F.when(hit, F.col("_asked")).otherwise(0), "last_used": F.when(hit, now).otherwise(F.col("last_used"))}).select(*cache.columns)


def found(lookups: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The lookups with the ``embedding`` of their entry; null for a miss."""
    live = cache.where(F.col("expires_at") > now).select("key", "embedding")
    return lookups.join(live, "key", "left")


def store(cache: DataFrame, new: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The cache with vectors (key, embedding) put in: a new key has one hit, a known one, expired
    or not, keeps created_at and has one hit more, as has a key for each further time that it
    stands among the new ones; all of them expire ``days`` from now. Of several vectors of one
    key the greatest is kept, so the order of rows doesn't matter."""
    rows = new.where("key is not null").groupBy("key").agg(F.max("embedding").alias("_e"), F.count("*").alias("_n"))
    there = F.col("_n").isNotNull()
    put = lambda value, name: F.when(there, value).otherwise(F.col(name)).alias(name)
    return cache.join(rows, "key", "full_outer").select(
        "key", put(F.col("_e"), "embedding"), (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("hit_count"),
        F.coalesce("created_at", now).alias("created_at"), put(now, "last_used"), put(now + F.make_dt_interval(F.lit(days)), "expires_at"))
