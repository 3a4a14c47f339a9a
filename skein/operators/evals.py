"""EVAL: checks of ranked results against expected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_at_k(results: DataFrame, expected: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """EVAL-2: hits in the top k / min(k, expected); 1 without expectation. results: case_id, id, rank."""
    want = expected.groupBy("case_id").agg(F.count("*").alias("n"))
    hits = results.where(F.col("rank") <= k).join(expected, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count("*").alias("h"))
    share = F.coalesce(F.col("h"), F.lit(0)) / F.least(F.col("n"), F.lit(k))
    joined = cases.select("case_id").join(want, "case_id", "left").join(hits, "case_id", "left")
    return joined.select("case_id", F.round(F.when(F.col("n").isNull(), 1.0).otherwise(share), 6).alias("precision"))


def rank_above(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """EVAL-4: whether ``higher`` stands before ``lower``; missing ids fail."""
    hi = results.select("case_id", F.col("id").alias("higher"), F.col("rank").alias("rh"))
    lo = results.select("case_id", F.col("id").alias("lower"), F.col("rank").alias("rl"))
    joined = pairs.join(hi, ["case_id", "higher"], "left").join(lo, ["case_id", "lower"], "left")
    return joined.select("case_id", "higher", "lower", F.coalesce(F.col("rh") < F.col("rl"), F.lit(False)).alias("passed"))


def ceilings(results: DataFrame, most: int) -> DataFrame:
    """EVAL-7: result counts per case against a ceiling."""
    return results.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("passed", F.col("n") <= most)


def forbidden(results: DataFrame, banned: DataFrame, k: int = 10) -> DataFrame:
    """EVAL-7: per case of (case_id, id, rank), how many forbidden (case_id, id) are in the first k."""
    hit = results.where(F.col("rank") <= k).join(banned.select("case_id", "id").distinct(), ["case_id", "id"], "left_semi")
    bad = hit.groupBy("case_id").agg(F.count("*").alias("_n"))
    return results.select("case_id").distinct().join(bad, "case_id", "left").select("case_id", F.coalesce("_n", F.lit(0)).alias("found"), F.col("_n").isNull().alias("passed"))


def confidence_ceiling(results: DataFrame, most: Column) -> DataFrame:
    """EVAL-7: per case, the best score against a ceiling; a case without scores passes."""
    best = results.groupBy("case_id").agg(F.max("score").alias("best"), F.max(most).alias("most"))
    return best.select("case_id", "best", F.coalesce(F.col("best") <= F.col("most"), F.lit(True)).alias("passed"))


def run_metrics(verdicts: DataFrame) -> DataFrame:
    """EVAL-9: per run: share passed, cases, mean precision, latency percentiles by nearest rank."""
    return verdicts.groupBy("run_id").agg(
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("score"), F.count("*").alias("cases"), F.round(F.avg("precision"), 6).alias("precision"),
        F.expr("percentile_disc(0.5) within group (order by latency)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by latency)").alias("p95"),
    )


def run_cases(cases: DataFrame, hits: DataFrame, records: DataFrame, limit: int = 10) -> DataFrame:
    """EVAL-1: external ids of each case's first hits (case_id, id, rank) in order; cases without hits have none."""
    rows = hits.where(F.col("rank") <= limit).join(records.select("id", "external_id"), "id")
    got = rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "external_id"))), lambda x: x.external_id).alias("ids"))
    return cases.select("case_id").join(got, "case_id", "left").select("case_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def expected_top(results: DataFrame, expected: DataFrame) -> DataFrame:
    """EVAL-3: whether the results start with exactly the expected ids (case_id, id, rank)."""
    rows = expected.withColumnRenamed("id", "want").join(results, ["case_id", "rank"], "left")
    return rows.groupBy("case_id").agg(F.bool_and(F.coalesce(F.col("id") == F.col("want"), F.lit(False))).alias("passed"))


def required_filters(applied: DataFrame, required: DataFrame) -> DataFrame:
    """EVAL-5: share of a case's required filters (case_id, field, op, value) that were applied."""
    keys = ["case_id", "field", "op", "value"]
    rows = required.join(applied.select(*keys).distinct().withColumn("hit", F.lit(1.0)), keys, "left")
    return rows.groupBy("case_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("share"))


def field_presence(results: DataFrame, rules: DataFrame) -> DataFrame:
    """EVAL-6: results (case_id, data as JSON) that hold a forbidden field, or lack a required one, per rule
    (case_id, field, forbidden)."""
    keys = results.select("case_id", F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>")).alias("keys"))
    rows = rules.join(keys, "case_id").withColumn("has", F.array_contains("keys", F.col("field")))
    return rows.groupBy("case_id", "field", "forbidden").agg(F.count_if(F.col("has") == F.col("forbidden")).alias("violations"))


def verdict(checks: DataFrame) -> DataFrame:
    """EVAL-8: checks (case_id, passed, reason) to whether a case passed, and the sorted reasons against it."""
    rows = checks.groupBy("case_id").agg(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("reason")))).alias("reasons"))
    return rows.select("case_id", (F.size("reasons") == 0).alias("passed"), "reasons")


def applicable_set(sources: DataFrame, sets: DataFrame) -> DataFrame:
    """EVAL-10: a source's own latest set, else that of its workspace; null if there is none."""
    last = lambda rows, key, name: rows.groupBy(key).agg(F.max_by("set_id", F.struct("updated_at", "set_id")).alias(name))
    own = last(sets.where("source_id is not null"), "source_id", "own")
    shared = last(sets.where("source_id is null"), "workspace_id", "shared")
    rows = sources.join(own, "source_id", "left").join(shared, "workspace_id", "left")
    return rows.select("source_id", F.coalesce("own", "shared").alias("set_id"))


def activation_gate(sources: DataFrame, runs: DataFrame, changes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """EVAL-11: sources (source_id, set_id, state) against the last completed run of their set (score, leaks,
    finished_at) and their last change (changed_at): the first reason against activation, else null."""
    last = runs.where("status = 'completed'").groupBy("set_id").agg(F.max_by(F.struct("score", "leaks", "finished_at"), F.struct("finished_at", "score", "leaks")).alias("r"))
    latest = changes.groupBy("source_id").agg(F.max("changed_at").alias("changed_at"))
    rows = sources.join(last, "set_id", "left").join(latest, "source_id", "left")
    reason = (
        F.when(F.col("state") != "validated", "not validated").when(F.col("set_id").isNull(), "no set").when(F.col("r").isNull(), "no run")
        .when(F.col("r.finished_at") <= F.col("changed_at"), "stale run").when(F.col("r.score") < threshold, "low score").when(F.col("r.leaks") > 0, "leaks")
    )
    return rows.select("source_id", reason.alias("reason"))


def promotable(runs: DataFrame, results: DataFrame) -> DataFrame:
    """EVAL-12: (run_id, source_id) that a passing run promotes: its set's source, else those of its results."""
    passing = runs.where("passed").select("run_id", "source_id")
    other = passing.where("source_id is null").select("run_id").join(results.select("run_id", "source_id"), "run_id")
    return passing.where("source_id is not null").unionByName(other).distinct()


def stale_runs(runs: DataFrame, now, minutes: int = 15) -> DataFrame:
    """EVAL-13: runs that have been running for more than so many minutes."""
    return runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {minutes} minutes")))
