"""RANK: query types, weights, preferences and the relevance of hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import normalize_text

# Words that make no concept; weight of each tier of fields.
STOP = "a al con de del el en la las los o para por un una y".split()
TIERS = {"a": 1.0, "b": 0.75, "c": 0.5, "d": 0.25}
# Patterns of measured quantities.
LITRES = r"\b([0-9]+(?:[.,][0-9]+)?)\s*(?:l|lt|lts|litro|litros)\b"
STROKES = r"\b([24])\s*(?:t|tiempo|tiempos)\b"


def query_type(queries: DataFrame, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """RANK-3: filter_only without text, lexical without vector hits, else hybrid_search; with a warning where no list has hits."""
    n = lambda hits, name: hits.groupBy("query_id").agg(F.count("*").alias(name))
    rows = queries.join(n(lexical, "nl"), "query_id", "left").join(n(vector, "nv"), "query_id", "left")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    kind = F.when(empty, "filter_only").when(F.col("nv").isNull(), "lexical").otherwise("hybrid_search")
    return rows.select("query_id", kind.alias("type"), F.when(~empty & F.col("nl").isNull() & F.col("nv").isNull(), "no candidates").alias("warning"))


def lexical_weight(queries: DataFrame, coverage: DataFrame, base: float = 1.0, raised: float = 1.45) -> DataFrame:
    """RANK-4: the lexical list's weight is ``raised`` at least if any of its hits holds a distinctive term."""
    best = coverage.groupBy("query_id").agg(F.max("coverage").alias("c"))
    weight = F.when(F.col("c") > 0, F.greatest(F.lit(base), F.lit(raised))).otherwise(base)
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", weight.alias("weight"))


def effective_weights(mappings: DataFrame, policies: DataFrame) -> DataFrame:
    """RANK-5: per source the weights of the policy, else of the mapping first in ``place``, else 1 and 1.1; the largest threshold."""
    first = mappings.groupBy("source").agg(
        F.min_by("lexical", F.when(F.col("lexical").isNotNull(), F.col("place"))).alias("ml"),
        F.min_by("vector", F.when(F.col("vector").isNotNull(), F.col("place"))).alias("mv"), F.max("least").alias("mt"))
    rows = first.join(policies.select("source", "lexical", "vector", "least"), "source", "left")
    return rows.select("source", F.coalesce("lexical", "ml", F.lit(1.0)).alias("lexical"), F.coalesce("vector", "mv", F.lit(1.1)).alias("vector"), F.greatest("least", "mt").alias("least"))


def cap(hits: DataFrame, queries: DataFrame, times: int = 3, least: int = 30) -> DataFrame:
    """RANK-6: the first max(times * limit, least) candidates of each query (query_id, limit)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = hits.withColumn("place", F.row_number().over(w)).join(queries.select("query_id", "limit"), "query_id")
    return rows.where(F.col("place") <= F.greatest(times * F.col("limit"), F.lit(least))).drop("limit")


def relax(queries: DataFrame, hits: DataFrame, filters: DataFrame, boost: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """RANK-7: (filters, preferences): for queries without hits, implicit filters that aren't protected become preferences."""
    empty = queries.select("query_id").join(hits, "query_id", "left_anti").withColumn("empty", F.lit(True))
    rows = filters.join(empty, "query_id", "left").withColumn("moves", F.coalesce("empty", F.lit(False)) & F.col("implicit") & ~F.col("protected"))
    kept = rows.where("not moves").select("query_id", "field", "op", "value")
    return kept, rows.where("moves").select("query_id", "field", "op", "value", F.coalesce("boost", F.lit(boost)).alias("boost"))


def search_relaxed(queries: DataFrame, filters: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], boost: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """RANK-7 with its second run: (hits with ``relaxed``, preferences) of queries (query_id, text,
    original). ``search`` takes queries (query_id, text) and filters (query_id, field, op,
    value) and gives hits (query_id, ...), in Spark, for all queries at once.

    Queries without hits that have a filter to move are searched again by their original text
    and the filters left; the others' results stand, empty or not. The first run's hits are
    read twice, so a search that costs much should store them.
    """
    plain = filters.select("query_id", "field", "op", "value")
    first = search(queries.select("query_id", "text"), plain)
    kept, moved = relax(queries, first.select("query_id").distinct(), filters, boost)
    again = queries.join(moved.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("original").alias("text"))
    second = search(again, kept.join(again.select("query_id"), "query_id", "left_semi"))
    return first.withColumn("relaxed", F.lit(False)).unionByName(second.withColumn("relaxed", F.lit(True))), moved


def preference_candidates(found: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """RANK-8: found (query_id, pref, id, updated_at) that aren't hits, the newest max(5 * limit, 50) of each
    preference, with half of the least positive score (0.01 at most)."""
    w = Window.partitionBy("query_id", "pref").orderBy(F.desc("updated_at"), "id")
    rows = found.withColumn("r", F.row_number().over(w)).join(queries.select("query_id", "limit"), "query_id").where(F.col("r") <= F.greatest(5 * F.col("limit"), F.lit(50)))
    floor = hits.where("score > 0").groupBy("query_id").agg(F.min("score").alias("s"))
    new = rows.select("query_id", "id").distinct().join(hits, ["query_id", "id"], "left_anti").join(floor, "query_id", "left")
    return new.select("query_id", "id", F.round(0.5 * F.least(F.coalesce("s", F.lit(0.01)), F.lit(0.01)), 8).alias("score"))


def pref_match(have: Column, op: Column, want: Column) -> Column:
    """RANK-9: whether a record's values (array of text) meet a preference: eq, in, containsAny any; neq none;
    contains, containsAll all; gt, gte, lt, lte on the first value as number. Unknown ops and nulls: false."""
    first, limit = F.get(have, F.lit(0)).try_cast("double"), F.get(want, F.lit(0)).try_cast("double")
    hit = (
        F.when(op.isin("eq", "in", "containsAny"), F.arrays_overlap(have, want)).when(op == "neq", ~F.arrays_overlap(have, want))
        .when(op.isin("contains", "containsAll"), F.size(F.array_except(want, have)) == 0)
        .when(op == "gt", first > limit).when(op == "gte", first >= limit).when(op == "lt", first < limit).when(op == "lte", first <= limit)
    )
    return F.coalesce(hit, F.lit(False))


def signals(hits: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """RANK-12: fields matched among the first n hits of each query, sorted."""
    rows = hits.where(F.col("place") <= n).join(matches.select("query_id", "id", "field").distinct(), ["query_id", "id"])
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def sanitize_prefs(prefs: DataFrame, fields: DataFrame, boost: float = 0.15) -> DataFrame:
    """RANK-13: distinct preferences on known, preferable, not sensitive fields; boost from preference, field, default."""
    rows = prefs.join(fields.select("field", "sensitive", "preferable", F.col("boost").alias("own")), "field").where("preferable and not sensitive")
    rows = rows.groupBy("query_id", "field", "op", "value").agg(F.max("boost").alias("b"), F.max("own").alias("own"))
    return rows.select("query_id", "field", "op", "value", F.coalesce("b", "own", F.lit(boost)).alias("boost"))


def _holds(text: Column, term: Column) -> Column:
    # a pattern is only made where the term is there at all
    return F.contains(text, term) & F.rlike(text, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), term, F.lit(r"\E([^a-z0-9]|$)")))


def concepts(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """RANK-14: (query_id, alternatives): terms of the dictionary (term, alias) that stand in the text, with their
    aliases, and its other words (two characters at least, no stop words, no digits). The join runs on the term's first word."""
    word = F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))
    q = queries.select("query_id", normalize_text(F.col("text")).alias("norm"))
    tokens = q.select("query_id", "norm", F.explode(F.array_distinct(word)).alias("token"))
    terms = dictionary.select(normalize_text(F.col("term")).alias("term"), normalize_text(F.col("alias")).alias("alias")).groupBy("term").agg(F.collect_set("alias").alias("aliases"))
    terms = terms.withColumn("token", F.regexp_extract("term", "[a-z0-9]+", 0)).where("token <> ''")
    found = tokens.join(terms, "token").where(_holds(F.col("norm"), F.col("term"))).select("query_id", "term", F.array_distinct(F.concat(F.array("term"), F.array_sort("aliases"))).alias("alternatives"))
    used = found.select("query_id", F.explode(F.regexp_extract_all("term", F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).distinct()
    rest = tokens.join(used, ["query_id", "token"], "left_anti").where(~F.col("token").isin(STOP) & ~F.col("token").rlike("^[0-9]+$") & (F.length("token") >= 2))
    return found.select("query_id", "alternatives").unionByName(rest.select("query_id", F.array("token").alias("alternatives"))).distinct()


def quantities(text: Column, pattern: str) -> Column:
    """RANK-16: the numbers of a pattern in a text's normal form."""
    return F.transform(F.regexp_extract_all(normalize_text(text), F.lit(pattern), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def quantity_conflict(query: Column, hit: Column) -> Column:
    """RANK-16: whether litres or strokes of the query are named in the hit with other values only."""
    out = F.lit(False)
    for pattern in (LITRES, STROKES):
        have = quantities(hit, pattern)
        out = out | ((F.size(have) > 0) & (F.size(F.array_except(quantities(query, pattern), have)) > 0))
    return out


def relevance(hits: DataFrame, parts: DataFrame, records: DataFrame) -> DataFrame:
    """RANK-15: (query_id, id, relevance, coverage, primary, conflict) of hits (query_id, id, score, distance or
    null, identifier) by concepts (query_id, alternatives) and records (id, a, b, c, d: text by tier).

    Queries without concepts have coverage 1. The concepts of one query are gathered: a text's length bounds them.
    """
    own = parts.groupBy("query_id").agg(F.array_sort(F.collect_set("alternatives")).alias("concepts"))
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    texts = records.select("id", *[normalize_text(F.coalesce(F.col(t), F.lit(""))).alias(t) for t in TIERS])
    rows = hits.join(top, "query_id").join(own, "query_id", "left").join(texts, "id")

    def strength(tiers: dict) -> Column:
        def one(c: Column) -> Column:
            out = F.lit(0.0)
            for tier, weight in reversed(tiers.items()):
                out = F.when(F.exists(c, lambda x: _holds(F.col(tier), x)), weight).otherwise(out)
            return out

        total = F.aggregate(F.transform("concepts", one), F.lit(0.0), lambda s, x: s + x) / F.size("concepts")
        return F.when(F.coalesce(F.size("concepts"), F.lit(0)) <= 0, 1.0).otherwise(total)

    rows = rows.withColumn("cov", strength(TIERS)).withColumn("prim", strength({"a": 1.0}))
    rows = rows.withColumn("clash", quantity_conflict(F.array_join(F.flatten(F.coalesce("concepts", F.array().cast("array<array<string>>"))), " "), F.concat_ws(" ", *TIERS)))
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    blend = 0.35 * F.when(F.col("top") > 0, one(F.col("score") / F.col("top"))).otherwise(0.0) + 0.4 * F.col("cov") + 0.2 * F.col("prim")
    blend = F.when(F.col("distance").isNull(), blend / 0.95).otherwise(blend + 0.05 * one(1 - F.col("distance")))
    score, sure = F.round(F.when(F.col("clash"), 0.35 * blend).otherwise(blend), 4), F.coalesce("identifier", F.lit(False))
    pick = lambda c: F.when(sure, 1.0).otherwise(c)
    return rows.select("query_id", "id", pick(score).alias("relevance"), pick(F.round("cov", 4)).alias("coverage"), pick(F.round("prim", 4)).alias("primary"), (F.col("clash") & ~sure).alias("conflict"))
