"""Filter interaction audit: what each order of five filters removes, part by part.

The documents are streamed: all files in ``MICRO_BATCHES`` available-now micro-batches (or
fewer). Each text gets a mask of the filters A to D that it fails. Whether it fails E (some
smaller id has the same text) can change with every later file, so there is a state, keyed
by the text's digest: the least id so far and the rows that stand for it. When a smaller id
arrives, these rows are taken back from their part's counter and counted again with E in
their mask; larger ids count with E at once. The counters are the sums of what all
micro-batches add and take back. All orders of the filters follow from the counters of the
32 masks.

Rows of a text are summed within each task before they meet its state, so a text that a
third of all rows repeat sends a few rows a task, not its copies. A micro-batch writes its
rows and the state that they met to the shared folder, under its number: one that is
repeated reads what the number before has left and writes its own place again. (State in the stream's own
store, by ``applyInPandasWithState``, took 6 ms of Python for each text.)

Defined results: a null text is empty, a null source the empty part. A null id is neither
smaller than another nor larger: its row never fails E. Rows of equal id and text count
each, none against the other. A document without labels, or with null ones, is neither good
nor toxic; of several label rows any may say so. Texts are taken whole. An empty table, or
a folder without files, gives no rows. Of other columns nothing is read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import give_back, pieces, plain_words, shared_dir

LETTERS = "ABCDE"
#: Micro-batches that the files are dealt over; each rewrites the state, some 60 bytes a text.
MICRO_BATCHES = 4
#: Sums that a task holds at most before it passes them on.
MOST_SUMS = 100_000
_UPPER = bytes(range(65, 91))
_ODD = re.compile(rb"[#$%&*|]")
_COMBINED = "digest binary, mask int, part string, good boolean, toxic boolean, n long, first long, n_first long"
_MET = f"{_COMBINED}, old boolean, least long"
_FLAGS = "k long, quality boolean, bad boolean"


def failed(text: bytes) -> int:
    """The mask of the filters A (1) to D (8) that a text fails."""
    words, points = plain_words(text), len(text.decode(errors="replace"))
    upper = len(text) - len(text.translate(None, _UPPER))
    tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * points, _ODD.search(text))
    return sum(1 << k for k, t in enumerate(tests) if t)


def _summed(df: DataFrame, schema: str, add: Callable[[Counter, dict], None], row: Callable[[tuple, object], tuple], text: str | None = None) -> DataFrame:
    """Rows summed within each task: ``add(sums, columns of a slice)``, then ``row(key, sum)``."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = df.sparkSession.createDataFrame([], schema).schema
    at = df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, sums = to_arrow_schema(kinds), {}

        def flush():
            columns = list(zip(*(row(k, v) for k, v in sums.items()))) or [()] * len(names)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for part in pieces(batch, at) if text else [batch]:
                add(sums, part.to_pydict())
                if len(sums) >= MOST_SUMS:
                    yield flush()
        yield flush()
        give_back()

    return df.mapInArrow(run, schema)


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, n): documents without their texts, equal rows counted."""

    def add(sums: dict, cols: dict) -> None:
        for i, p, t in zip(cols["i"], cols["p"], cols["t"]):
            key = (i, p, blake2b(t, digest_size=16).digest())
            mask, n = sums.get(key) or (failed(t), 0)
            sums[key] = (mask, n + 1)

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("i"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("p"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"),
    )
    return _summed(narrow, "doc_id long, part string, digest binary, mask int, n long", add, lambda k, v: (*k, *v), "t")


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, mask, part, good, toxic, n, first, n_first): the rows of a task, by text and
    kind; of n rows n_first have the least id ``first``. Rows without id are apart."""

    def add(sums: dict, cols: dict) -> None:
        for i, p, d, m, n, g, x in zip(*(cols[c] for c in ("doc_id", "part", "digest", "mask", "n", "good", "toxic"))):
            key = (d, m, p, g, x, i is None)
            rows, first, at_first = sums.get(key) or (0, i, 0)
            if i is not None and i < first:
                first, at_first = i, 0
            sums[key] = (rows + n, first, at_first + (n if i == first else 0))

    return _summed(rows, _COMBINED, add, lambda k, v: (*k[:5], *v))


def _met(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """New rows of texts and those that stand for them so far (``old``), with each text's least id ``least``."""
    new = rows.withColumn("old", F.lit(False))
    if state is not None:
        new = new.unionByName(state.select(*rows.columns, F.lit(True).alias("old")))
    return new.withColumn("least", F.min("first").over(Window.partitionBy("digest")))


def standing(met: DataFrame) -> DataFrame:
    """The rows of ``_met`` that stand for their text from now on: those of its least id."""
    return met.where("first = least").withColumn("n", F.col("n_first"))


def changes(met: DataFrame) -> DataFrame:
    """(batch, part, mask, good, toxic, back, n): what the rows of ``_met`` add to the counters, n < 0 where taken back."""
    first = F.when(F.col("first").isNull(), F.col("n")).when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    now = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - first).alias("n")))
    back = F.array(F.struct(F.col("mask"), (-F.col("n")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.col("n")))
    none = F.array().cast("array<struct<mask: int, n: bigint>>")
    each = F.when(~F.col("old"), now).when(F.col("first") > F.col("least"), back).otherwise(none)
    rows = met.select("batch", "part", "good", "toxic", F.explode(each).alias("c")).select("batch", "part", "c.mask", "good", "toxic", "c.n").where("n <> 0")
    return rows.groupBy("batch", "part", "mask", "good", "toxic", (F.col("n") < 0).alias("back")).agg(F.sum("n").alias("n"))


def mask_counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = MICRO_BATCHES, schema: str = "doc_id long, text string, source string") -> DataFrame:
    """What each micro-batch changes (``changes``) of all Parquet files at ``path``."""
    home = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    flag = lambda c, name: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(flag("quality", "quality"), flag("toxic", "bad")).where("quality or bad")
    known.write.parquet(f"{home}/labels")
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    # as a pattern, the path may name a single file too
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path[:-1]}[{path[-1]}]")
    has = lambda c: F.coalesce(F.col(c) & F.col("doc_id").isNotNull(), F.lit(False))

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        key = F.coalesce("doc_id", F.xxhash64("digest"))  # rows without id are spread
        rows = _measured(batch).join(own.read.schema(_FLAGS).parquet(f"{home}/labels"), key == F.col("k"), "left")
        rows = _combined(rows.select("doc_id", "part", "digest", "mask", "n", has("quality").alias("good"), has("bad").alias("toxic")))
        state = standing(own.read.schema(_MET).parquet(f"{home}/met/batch={number - 1}")) if number else None
        _met(rows, state).write.mode("overwrite").parquet(f"{home}/met/batch={number}")

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress:
        return changes(spark.createDataFrame([], f"{_MET}, batch int"))
    return changes(spark.read.schema(f"{_MET}, batch int").parquet(f"{home}/met"))


def all_orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, mask of the filters before) of all 120 orders."""
    out = []
    for order in permutations(range(5)):
        for step, k in enumerate(order):
            out.append(("".join(LETTERS[x] for x in order), step + 1, 1 << k, sum(1 << x for x in order[:step])))
    return out


def order_report(counters: DataFrame) -> DataFrame:
    """Counters (part, mask, good, toxic, n) to one row per part, order and step."""
    sums = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders, mask = all_orders(), np.arange(32)
        bit, before = (np.array([o[k] for o in orders])[:, None] for k in (2, 3))
        fails = (mask & bit) > 0
        gone = (mask & before) > 0
        share = np.array([120 // max(1, m.bit_count()) for m in range(32)])
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"]):
                table = np.zeros((3, 32), dtype=np.int64)
                for c in counts:
                    table[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                n, good, toxic = table
                values = (
                    ~(fails | gone) @ n, (fails & ~gone) @ n, (fails & gone) @ n, (mask == bit) @ n,
                    (fails & ~gone) @ good, (fails & ~gone) @ toxic, fails @ (n * share),
                )
                yield pd.DataFrame({"part": part, "filter_order": [o[0] for o in orders], "step": [o[1] for o in orders], **dict(zip(names, values))})

    return parts.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in names))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = MICRO_BATCHES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return order_report(mask_counters(spark, path, labels, batches))
