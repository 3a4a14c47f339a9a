"""How many parts a shuffle gets, where its number has to grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part, about.
ROWS = 200_000


def parts_of(table: DataFrame, rows: int = ROWS) -> int:
    """Parts of some ``rows`` rows each of a stored table, whose rows are counted; at least one for each core."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows in that many parts by keys; without a number, as Spark deals them."""
    return df if parts is None else df.repartition(parts, *keys)
