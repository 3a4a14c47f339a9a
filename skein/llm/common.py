"""What the corpus operators share: reading tables, cutting words, shared storage.

Two word cuts are used throughout, both on the UTF-8 bytes of a text:

* ``plain_words``: runs of anything but blank, tab, line feed, vertical tab,
  form feed and carriage return.
* ``folded_words``: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at a time while a table is written.
BATCH_ROWS = 1000
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space; ``bytes.split`` cuts at exactly those six bytes."""
    return text.split()


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves a local master (tests); on a cluster it
    is an error, as each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    Meanwhile rows go to Python in small batches, as they hold texts or sets.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}/{name}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_memory() -> None:
    """Let this worker keep some 64 MB that it has freed, up to ``give_back``: large arrays that are
    made and freed at each step would else be given by the system anew, page by page, each time."""
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: larger arrays still go back at once
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return what this worker has freed to the system: workers go on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list], dict[str, list]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_bytes: bool = True,
) -> DataFrame:
    """Run a batch function over (ids, texts) of all rows, without a shuffle.

    Only the two named columns are read, so other columns can have any name.
    ``make`` is called once per task and gives the function; a null text comes as
    empty. The function returns the columns of ``schema``, of any equal length.
    """
    kind = "binary" if as_bytes else "string"
    narrow = docs.select(
        F.col(id_col).alias("i"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast(kind).alias("t"),
    )
    probe = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, call = to_arrow_schema(probe), make()
        for batch in batches:
            for part in pieces(batch, 1):
                out = call(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )
        if end := getattr(call, "finish", None):
            for out in end():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )
        del call
        give_back()

    return narrow.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: int, rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a bounded number of rows and bytes of text (but of one row at
    least), so that Python objects and arrays exist for little text at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, size + (ends[start - 1] if start else 0), "right"))
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def change_rows(
    docs: DataFrame, make: Callable[[], Callable[[list], tuple]], text_col: str = "text"
) -> DataFrame:
    """Filter rows or rewrite texts in place; every column is kept, whatever its name.

    The batch function gets the texts as str (null: empty) and returns
    (mask or None, new texts or None); a text that it gives as None stays as it was.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in pieces(batch, at):
                mask, texts = call([x or "" for x in part.column(at).to_pylist()])
                if texts is not None:
                    old = part.column(at).to_pylist()
                    new = pa.array([n if n is not None else o for n, o in zip(texts, old)], type=part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), new)
                yield part if mask is None else part.filter(pa.array(mask, type=pa.bool_()))
        del call
        give_back()

    return docs.mapInArrow(run, schema)
