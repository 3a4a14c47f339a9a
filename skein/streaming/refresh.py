"""STR-4: a catalog kept up to date by events, as a log of changes that reads merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refreshed(events: DataFrame, products: DataFrame, guard: int = 100) -> DataFrame:
    """Changes from events (event_id, ts, kind, product) and the products' rows of now.

    Kinds: update and inventory fetch a product's rows again, delete removes them; others
    and events without a product do nothing. One row (product, at, whole, row) for each row
    that was fetched, and one with a null row if there is none; ``at`` is the product's last
    event, and ``whole`` is false if the list has ``guard`` rows or more and may be cut."""
    known = events.where(F.col("kind").isin("update", "inventory", "delete") & F.col("product").isNotNull())
    last = known.groupBy("product").agg(F.max(F.struct("ts", "event_id", "kind")).alias("e"))
    last = last.select("product", F.struct("e.ts", "e.event_id").alias("at"), F.col("e.kind").alias("kind"))
    rows = products.select("product", F.struct("*").alias("row"))
    live = last.where("kind <> 'delete'").join(rows, "product")
    cut = live.groupBy("product").agg((F.count("*") < guard).alias("whole"))
    return last.join(live.select("product", "row"), "product", "left").join(cut, "product", "left").select("product", "at", F.coalesce("whole", F.lit(True)).alias("whole"), "row")


def apply_events(stream: DataFrame, products: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's changes to the log; a batch that runs again replaces its part."""
    def put(batch: DataFrame, number: int) -> None:
        refreshed(batch, products).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(stored: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The stored rows (with column product) under a log: rows of a product from before its
    last whole refresh or removal are gone, and of each key the last row stands. The order
    of batches doesn't matter, only the events'."""
    whole = log.where("whole").groupBy("product").agg(F.max("at").alias("since"))
    late = log.where("row is not null").join(whole, "product", "left").where("since is null or at >= since")
    newest = late.groupBy(F.col(f"row.{key}").alias("_k")).agg(F.max_by("row", "at").alias("row"))
    old = stored.join(whole.select("product"), "product", "left_anti").join(newest.select(F.col("_k").alias(key)), key, "left_anti")
    return old.select(*stored.columns).unionByName(newest.select("row.*").select(*stored.columns))
