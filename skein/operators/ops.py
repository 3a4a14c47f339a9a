"""OPS: reports on query logs, jobs and state histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_logs(logs: DataFrame, condition: Column, time: str, id_: str, n: int, before: tuple | None = None) -> DataFrame:
    """OPS-1: newest first, n + 1 rows after a (time, id) cursor."""
    rows = logs.where(condition)
    if before:
        t, i = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        rows = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(id_) < i)))
    return rows.orderBy(F.desc(time), F.desc(id_)).limit(n + 1)


def query_stats(logs: DataFrame, group: list[str], latency: str, error: Column) -> DataFrame:
    """OPS-2: rows, errors and interpolated latency percentiles."""
    return logs.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(error).alias("errors"),
        F.round(F.percentile(latency, 0.5), 6).alias("p50"), F.round(F.percentile(latency, 0.95), 6).alias("p95"),
    )


def status_counts(df: DataFrame, *cols: str) -> DataFrame:
    """OPS-3, 5: rows by state."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def illegal_steps(transitions: DataFrame, allowed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """OPS-6: steps from one state to the next that the table of allowed pairs lacks."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = transitions.withColumn("before", F.lag("state").over(w)).where("before is not null")
    return steps.join(F.broadcast(allowed), (F.col("before") == F.col("from_state")) & (F.col("state") == F.col("to_state")), "left_anti")


def current_state(transitions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """OPS-6: the last state of each key."""
    return transitions.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state"), F.count("*").alias("steps"))


def active_version(versions: DataFrame, key: str) -> DataFrame:
    """OPS-7: the latest active version of each key, and the next version to give."""
    return versions.groupBy(key).agg(F.max(F.when(F.col("status") == "active", F.col("version"))).alias("active"), (F.max("version") + 1).alias("next"))


def ingest_stats(jobs: DataFrame, now: Column) -> DataFrame:
    """OPS-4: open jobs by state, their records and the oldest one, and what was finished in
    the last 15 and 60 minutes, with the percentiles of job durations.

    jobs: state (pending, active, retry, completed), n_records, created, started, finished."""
    ago = lambda minutes: (F.col("state") == "completed") & (F.col("finished") > now - F.make_interval(mins=F.lit(minutes)))
    seconds = F.when(ago(60), F.unix_millis(F.col("finished").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))) / 1000.0
    open_ = F.col("state").isin("pending", "retry")
    return jobs.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "active", "retry")],
        F.coalesce(F.sum(F.when(open_, F.col("n_records"))), F.lit(0)).alias("pending_records"), F.min(F.when(open_, F.col("created"))).alias("oldest"),
        *[F.coalesce(F.sum(F.when(ago(m), F.col("n_records"))), F.lit(0)).alias(f"records_{m}") for m in (15, 60)],
        F.round(F.percentile(seconds, 0.5), 6).alias("p50"), F.round(F.percentile(seconds, 0.95), 6).alias("p95"),
    )


def pending_backfills(jobs: DataFrame) -> DataFrame:
    """OPS-8: the distinct (source, workspace, version) of open jobs."""
    return jobs.where(F.col("state").isin("pending", "active", "retry")).select("source", "workspace", "version").distinct()


def log_rows(queries: DataFrame, results: DataFrame, warnings: DataFrame) -> DataFrame:
    """OPS-9: a log row per query: results, best score, warnings and error."""
    found = results.groupBy("query_id").agg(F.count("*").alias("n_results"), F.max("score").alias("confidence"))
    told = warnings.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("warning")), "; ").alias("warnings"))
    rows = queries.join(found, "query_id", "left").join(told, "query_id", "left")
    return rows.select(*queries.columns, F.coalesce("n_results", F.lit(0)).alias("n_results"), "confidence", F.coalesce("warnings", F.lit("")).alias("warnings"))
