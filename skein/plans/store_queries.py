"""Queries of the vector cache as a keyed store of three versions, and of metrics as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import query_cache
from skein.plans.more_queries import scratch
from skein.plans.registry import session_query
from skein.sources.readers import read_table
from skein.sources.store import read_store, versions, write_keyed
from skein.streaming import streams


# day 0 stores, day 3 looks all odd parts up and stores misses, day 8 (first entries are expired) again
@session_query("emb_7_store", """WITH p AS (SELECT p_partkey, p_size, p_type || ' ' || p_size AS q FROM part), a AS (SELECT DISTINCT q FROM p WHERE p_partkey % 2 = 0 AND p_size < 25), o AS (SELECT q, count(*) AS n FROM p WHERE p_partkey % 2 = 1 GROUP BY 1), big AS (SELECT q, count(*) AS n FROM p WHERE p_size > 20 GROUP BY 1),
k AS (SELECT q, a.q IS NOT NULL AS first, o.n AS odd, big.n AS late FROM (SELECT q FROM a UNION SELECT q FROM o UNION SELECT q FROM big) LEFT JOIN a USING (q) LEFT JOIN o USING (q) LEFT JOIN big USING (q)),
s AS (SELECT *, CASE WHEN first THEN 1 + coalesce(odd, 0) ELSE coalesce(odd, 0) END AS h, CASE WHEN first THEN 7 WHEN odd IS NOT NULL THEN 10 END AS ends, CASE WHEN odd IS NOT NULL THEN 3 ELSE 0 END AS used FROM k)
SELECT sha256('m' || chr(10) || '3' || chr(10) || lower(q)) AS key, h + coalesce(late, 0) AS hits, CASE WHEN first THEN 0 WHEN odd IS NOT NULL THEN 3 ELSE 8 END AS created, CASE WHEN late IS NOT NULL THEN 8 ELSE used END AS used, CASE WHEN late IS NOT NULL AND coalesce(ends, 0) < 8 THEN 15 ELSE ends END AS ends, 3 AS version FROM s""")
def _(spark, sf_dir):
    path = scratch(spark) + "/cache"
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", query_cache.query_key(F.lit("m"), F.lit(3), F.concat(F.lit("  "), F.upper("p_type"), F.lit(" \t"), F.col("p_size"))).alias("key"))
    now = lambda d: F.lit(f"2024-01-{d + 1:02d} 00:00:00").cast("timestamp")
    cache = lambda: read_store(spark, path, query_cache.SCHEMA)
    vector = F.array(F.lit(1.0)).alias("embedding")
    write_keyed(query_cache.store(cache(), p.where("p_partkey % 2 = 0 and p_size < 25").select("key").distinct().select("key", vector), now(0)), path, ["key"])
    for day, asked in ((3, p.where("p_partkey % 2 = 1").select("key")), (8, p.where("p_size > 20").select("key"))):
        misses = query_cache.found(asked, cache(), now(day)).where("embedding is null").select("key", vector)  # a row per miss
        write_keyed(query_cache.store(query_cache.record_hits(cache(), asked, now(day)), misses, now(day)), path, ["key"])
    day = lambda c: F.date_diff(c, F.lit("2024-01-01")).cast("int")
    return cache().select("key", F.col("hit_count").alias("hits"), day("created_at").alias("created"), day("last_used").alias("used"), day("expires_at").alias("ends"), F.lit(versions(spark, path)[-1]).alias("version"))


# four files in order of time: the third brings rows whose window is open still, the fourth a fifth of the first days' rows, too late
@session_query("str_6_stream", """WITH e AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, * FROM events)
SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM e
WHERE NOT (event_id % 5 = 0 AND ts < TIMESTAMP '2024-01-11') AND start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events) GROUP BY 1""")
def _(spark, sf_dir):
    path = scratch(spark)
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ts, n = F.col("ts"), F.col("event_id")
    part = F.when(ts >= "2024-01-25", 4).when((ts < "2024-01-11") & (n % 5 == 0), 4).when((ts >= "2024-01-21") | (ts >= "2024-01-20 18:00:00") & (n % 7 == 0), 3).when(ts >= "2024-01-11", 2).otherwise(1)
    for k in (1, 2, 3, 4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(path + "/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path + "/events")
    out = streams.tumbling_metrics(stream, "ts", "value", F.col("event_type") == "error", "6 hours")
    streams.log_stream(out, path + "/out", path + "/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(path + "/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
