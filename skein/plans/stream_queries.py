"""Queries of the streams with state, over events as a file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.more_queries import _stream, scratch
from skein.plans.registry import session_query
from skein.sources.readers import read_table
from skein.streaming import refresh, state, streams


def _run(spark, frame):
    """What a stream writes until its source has nothing new."""
    path = scratch(spark)
    streams.log_stream(frame, path + "/out", path + "/state").awaitTermination()
    return spark.read.schema(frame.schema).parquet(path + "/out")


# a fold over each key's rows in order, one row a turn
@session_query("str_3_rate_limit", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT *, ts AS start, 1::BIGINT AS place FROM e WHERE r = 1 UNION ALL SELECT e.*, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN 1 ELSE w.place + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, event_id, epoch_us(ts) - epoch_us(start) AS since, place, place <= 2 AS allowed FROM w""")
def _(spark, sf_dir):
    out = state.rate_limit(_stream(spark, sf_dir, "events"), ["user_id"], "event_id", "ts", 2, 24 * 3600)
    return _run(spark, out).select("user_id", F.col("id").alias("event_id"), (F.col("t") - F.col("start")).alias("since"), "place", "allowed")


@session_query("str_1_2_deliveries", """WITH RECURSIVE v AS (SELECT event_id, event_type, CASE WHEN user_id % 10 <> 9 THEN user_id END AS hook, epoch_us(ts) AS t, CASE event_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' END AS outcome, epoch_us(ts) + CAST(round(value * 3600) AS BIGINT) * 1000000 AS finish FROM events),
e AS (SELECT event_id, event_type, hook, t, coalesce(outcome, 'processing') AS outcome, CASE WHEN outcome IS NOT NULL THEN finish ELSE 9223372036854775807 END AS ended, row_number() OVER (PARTITION BY event_type, hook ORDER BY t, event_id) AS r FROM v),
w AS (SELECT *, true AS processed, t AS pt, ended AS pe, outcome AS po FROM e WHERE r = 1 AND hook IS NOT NULL
UNION ALL SELECT x.* EXCLUDE (lt, le, lo), CASE WHEN processed THEN t ELSE lt END, CASE WHEN processed THEN ended ELSE le END, CASE WHEN processed THEN outcome ELSE lo END FROM (SELECT e.*, CASE WHEN e.t >= w.pe THEN w.po = 'failed' ELSE e.t - w.pt > 172800000000 END AS processed, w.pt AS lt, w.pe AS le, w.po AS lo FROM w JOIN e ON e.event_type = w.event_type AND e.hook = w.hook AND e.r = w.r + 1) x),
a AS (SELECT event_id, processed, outcome, ended, t FROM w UNION ALL SELECT event_id, true, outcome, ended, t FROM e WHERE hook IS NULL)
SELECT event_id, processed, CASE WHEN processed THEN outcome ELSE 'ignored' END AS status, CASE WHEN processed AND ended < 9223372036854775807 THEN ended - t END AS took FROM a""")
def _(spark, sf_dir):
    seconds = F.round(F.col("value") * 3600).cast("long")
    events = _stream(spark, sf_dir, "events").withColumns({
        "at": F.col("ts").cast("timestamp"), "hook": F.when(F.col("user_id") % 10 != 9, F.col("user_id")),
        "outcome": F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 3 == 1, "completed"),
    }).withColumn("ended", F.timestamp_micros(F.unix_micros("at") + seconds * 1_000_000))
    out = _run(spark, state.deliveries(events, "event_type", "hook", "event_id", "at", "outcome", "ended", 2 * 24 * 3600))
    return out.select(F.col("id").alias("event_id"), "processed", "status", (F.col("ended") - F.col("t")).alias("took"))


@session_query("str_5_increments", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS DISTINCT FROM event_type")
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("increment"))  # as overlapping increments bring rows
    out = _run(spark, state.changed_rows(twice, ["user_id"], "event_id", "ts", F.col("event_type")))
    return out.select("user_id", F.col("id").alias("event_id"), F.col("hash").alias("event_type"))


@session_query("str_4_refresh", """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1), p AS (SELECT p_partkey, p_partkey // 10 AS product, p_name FROM part)
SELECT p_partkey, product, p_name, 'old' AS state FROM p WHERE p_partkey % 3 <> 0 AND product NOT IN (SELECT user_id FROM l)
UNION ALL SELECT p_partkey, product, p_name, 'new' FROM p JOIN l ON product = user_id WHERE kind <> 'error' AND p_partkey % 4 <> 0""")
def _(spark, sf_dir):
    path = scratch(spark)
    kinds = F.when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "signup", "inventory").when(F.col("event_type") == "error", "delete")
    files = path + "/events"  # several files, a micro-batch each
    read_table(spark, sf_dir, "events").select("event_id", "ts", kinds.alias("kind"), F.col("user_id").alias("product")).repartition(3, "event_id").write.parquet(files)
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("product"), "p_name")
    stored, live = (parts.where(w).withColumn("state", F.lit(s)) for w, s in (("p_partkey % 3 <> 0", "old"), ("p_partkey % 4 <> 0", "new")))
    stream = spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)
    refresh.apply_events(stream, live, path + "/log", path + "/state").awaitTermination()
    return refresh.current(stored, spark.read.parquet(path + "/log"), "p_partkey")
