"""RANK: fusion of ranked lists, re-scoring, pruning and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.parts import spread


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """RANK-1: rows (query_id, id, rank, weight) to the sum of weight / (k + rank) per id, with its place."""
    fused = rankings.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("place", F.row_number().over(w))


def fuse(lexical: DataFrame, vector: DataFrame, limit: int, weights: tuple[float, float] = (1.0, 1.1)) -> DataFrame:
    """RANK-2: lexical hits (query_id, id, rank, relevance, identifier, exact) and vector hits
    (query_id, id, rank, distance) as one list: identifiers first (score 1, by lexical rank),
    then by exact, then by the fused score. A query without vector hits keeps the lexical
    order, with the relevance as score."""
    one = lexical.select("query_id", "id", "rank", F.lit(weights[0]).alias("weight"))
    two = vector.select("query_id", "id", "rank", F.lit(weights[1]).alias("weight"))
    fused = rrf(one.unionByName(two)).drop("place")
    rows = fused.join(lexical.withColumnRenamed("rank", "lexical_rank"), ["query_id", "id"], "left")
    rows = rows.join(vector.select("query_id", "id", "distance"), ["query_id", "id"], "left")
    both = vector.select("query_id").distinct().withColumn("_both", F.lit(True))
    named = F.coalesce("identifier", F.lit(False))
    rows = rows.join(both, "query_id", "left").withColumn("score", F.when(named, 1.0).when(F.col("_both").isNull(), F.col("relevance")).otherwise(F.col("score")))
    alone = F.col("_both").isNull()
    w = Window.partitionBy("query_id").orderBy(
        F.desc(named), F.when(named | alone, F.col("lexical_rank")), F.desc(F.coalesce("exact", F.lit(0))), F.desc("score"), "id"
    )
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return rows.select("query_id", "id", "score", "lexical_rank", "distance", "place")


def rescore(hits: DataFrame, matches: DataFrame, cap: float = 0.75, parts: int | None = None) -> DataFrame:
    """RANK-10, 11: hits (query_id, id, score) and preference matches (query_id, id, field, boost):
    the largest boost of each field, summed up to a cap; ordered by fields matched, score, id.
    parts: of the shuffles, see ``parts_of``; hits and matches lie by query_id and id in as many."""
    best = matches.groupBy("query_id", "id", "field").agg(F.max("boost").alias("b"))
    total = best.groupBy("query_id", "id").agg(F.least(F.sum("b"), F.lit(cap)).alias("boost"), F.count("*").alias("fields"))
    out = hits.join(total, ["query_id", "id"], "left").select(
        "query_id", "id", F.round(F.col("score") * (1 + F.coalesce("boost", F.lit(0.0))), 6).alias("score"), F.coalesce("fields", F.lit(0)).alias("fields")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("fields"), F.desc("score"), "id")
    return spread(out, parts, "query_id").withColumn("place", F.row_number().over(w))


def finalize(hits: DataFrame, least: float, limit: int) -> DataFrame:
    """RANK-17: hits below the least relevance go (identifier hits stay); top ``limit`` of each query."""
    kept = hits.where((F.col("relevance") >= least) | F.col("identifier"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("identifier").cast("int")), F.desc("exact"), F.desc("score"), "id")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def confidence(gap: Column, filters: Column, lexical: Column, distinctive: Column, fill: Column) -> Column:
    """RANK-18: weighted sum of five signals between 0 and 1."""
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.round(0.25 * one(gap) + 0.15 * one(filters) + 0.2 * one(lexical) + 0.25 * one(distinctive) + 0.15 * one(fill), 4)


def weak(c: Column, least: float = 0.45) -> Column:
    """RANK-19: whether an answer is weak."""
    return c < least
