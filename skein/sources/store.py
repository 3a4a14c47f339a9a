"""SRC-9: tables with unique keys, written as versions that readers never see half done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a store, in order; none where there is no store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("v")]
    child = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[1:]) for p in found if files.exists(child(p, "_SUCCESS")))


def read_store(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The newest whole version or a given one; an empty table before the first."""
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} in {path}")
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{version if version is not None else known[-1]:08d}")


def write_keyed(df: DataFrame, path: str, keys: list[str]) -> int:
    """Writes the next version and gives its number. A key that repeats or is null is refused
    before a reader sees the version; of two writers of one version the later one fails.

    The rows are written once and checked as written, so an expensive or unstable plan is
    neither run twice nor checked on other rows than those stored. Readers of older versions
    go on undisturbed."""
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    target, draft = f"{path}/v{number:08d}", f"{path}/_draft{number:08d}"
    df.write.mode("errorifexists").parquet(draft)
    rows = spark.read.schema(df.schema).parquet(draft)
    bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)).cast("boolean")).head(1)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if bad:
        files.delete(jvm(draft), True)
        raise ValueError(f"a key of {keys} is null or repeats: {bad[0]}")
    if files.exists(jvm(target)) or not files.rename(jvm(draft), jvm(target)):
        raise ValueError(f"version {number} of {path} was written by another job")
    return number
