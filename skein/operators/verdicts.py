"""RANK-11, 17, 18: what stays of a query's ranked hits, and how sure the answer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preference_misses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """RANK-11: (query_id, preference_fallback): true for a query with preferences (column
    ``preferences`` > 0) that has candidates, none of which matches one (column ``fields``)."""
    best = hits.groupBy("query_id").agg(F.max("fields").alias("_best"))
    return queries.join(best, "query_id", "left").select("query_id", ((F.col("preferences") > 0) & (F.coalesce("_best", F.lit(1)) == 0)).alias("preference_fallback"))


def prune(hits: DataFrame, limits: DataFrame, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """RANK-17: the hits that stay, with their place, and (query_id, kept, pruned) of each query.

    A hit (query_id, id, relevance, primary_coverage, identifier, exact) stays if it is an
    identifier's, else if relevance and coverage reach the query's least ones (limits:
    query_id, min_relevance, min_coverage, limit); null reaches nothing. Identifier hits stand
    first, then exact signal, relevance, id; the query's ``limit``, ``most`` at the highest,
    cuts the list. ``kept`` and ``pruned`` count all hits, before that cut; a query without
    hits has zeros. Counts are summed in the tasks before they meet.
    """
    known = hits.join(limits, "query_id")
    good = F.coalesce("identifier", F.lit(False)) | F.coalesce((F.col("relevance") >= F.col("min_relevance")) & (F.col("primary_coverage") >= F.col("min_coverage")), F.lit(False))
    known = known.withColumn("_good", good)
    counts = known.groupBy("query_id").agg(F.count_if("_good").alias("kept"), F.count_if(~F.col("_good")).alias("pruned"))
    counts = limits.select("query_id").join(counts, "query_id", "left").na.fill(0, ["kept", "pruned"])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("identifier", F.lit(False))), F.desc(F.coalesce("exact", F.lit(0))), F.desc("relevance"), "id")
    top = known.where("_good").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).where(F.col("place") <= F.col("limit"))
    return top.select(*hits.columns, "place"), counts


def _unit(c: Column) -> Column:
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 4)


def query_confidence(queries: DataFrame, top: DataFrame, candidates: DataFrame, misses: DataFrame) -> DataFrame:
    """RANK-18: (query_id, confidence) of every query (query_id, requested, applied, limit,
    free_text, hybrid) from its pruned hits ``top`` (place, relevance, lexical, term_coverage).

    A quarter is the gap between first and second score, as a share of the first; 0.15 the
    share of requested filters that were applied (all without any); 0.2 a first hit found by
    words; a quarter the distinctive words in it; 0.15 how far the list is filled. A hybrid
    query with text, for which no candidate was found by words, is held to 0.42 unless a third
    (0.34) of the distinctive words is in the first hit; an answer without any of the preferred
    values (RANK-11) counts half. A query without hits has its filters' share only.
    """
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    found = top.groupBy("query_id").agg(at(1, "relevance").alias("s1"), at(2, "relevance").alias("s2"), at(1, "lexical").alias("lex"), at(1, "term_coverage").alias("cover"), F.count("*").alias("n"))
    worded = candidates.groupBy("query_id").agg(F.max("lexical").alias("worded"))
    q = queries.join(found, "query_id", "left").join(worded, "query_id", "left").join(misses, "query_id", "left")
    s1, s2 = F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))
    gap = F.when(s1 > 0, F.least(F.greatest((s1 - s2) / s1, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    applied = F.when(F.col("requested") > 0, F.least(F.col("applied") / F.col("requested"), F.lit(1.0))).otherwise(1.0)
    lexical, cover = F.coalesce("lex", F.lit(False)), _unit(F.coalesce("cover", F.lit(0.0)))
    fill = F.when(F.col("limit") > 0, F.least(F.coalesce("n", F.lit(0)) / F.col("limit"), F.lit(1.0))).otherwise(0.0)
    raw = _unit(0.25 * gap + 0.15 * applied + 0.2 * lexical.cast("double") + 0.25 * cover + 0.15 * fill)
    vectors_only = F.col("free_text") & F.col("hybrid") & ~F.coalesce("worded", F.lit(False)) & ~lexical & (cover < 0.34)
    capped = F.when(vectors_only, F.least(raw, F.lit(0.42))).otherwise(raw)
    return q.select("query_id", F.when(F.coalesce("preference_fallback", F.lit(False)), F.round(capped * 0.5, 4)).otherwise(capped).alias("confidence"))
