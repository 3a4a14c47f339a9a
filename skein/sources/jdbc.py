"""SRC-2: whole tables of a database over JDBC, in parts of equal size, with its catalog.

The catalog comes from the driver's own metadata, so any database whose JDBC driver is on
Spark's class path can be read. Executors read the rows themselves; only the catalog and
the borders of the parts pass the driver.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.raw import classify_tables

CATALOG = "schema string, table string, place int, column string, is_pk boolean, is_fk boolean, referenced_table string, referenced_column string, key_place int"


@contextmanager
def connect(spark: SparkSession, url: str, properties: dict[str, str] | None = None):
    """A JDBC connection of the driver's JVM, closed at the end."""
    settings = spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        settings.setProperty(k, v)
    if "driver" in (properties or {}):
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    found = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        yield found
    finally:
        found.close()


def _rows(result, *names: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getString(n) for n in names))
    result.close()
    return out


def read_catalog(spark: SparkSession, url: str, schema: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A row per column of every table of a schema (of all without one): whether it belongs to
    the primary key, where in it (from 1), and what it refers to. A column of several foreign
    keys shows the one that names the least table."""
    with connect(spark, url, properties) as c:
        meta = c.getMetaData()
        kinds = spark._sc._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        rows, place = [], 0
        space = c.getCatalog()
        for owner, of, name in sorted(_rows(meta.getTables(space, schema, "%", kinds), "TABLE_SCHEM", "TABLE_CAT", "TABLE_NAME"), key=str):
            keys = {k: int(n) for k, n in _rows(meta.getPrimaryKeys(space, owner, name), "COLUMN_NAME", "KEY_SEQ")}
            foreign = {k: (t, r) for k, t, r in sorted(_rows(meta.getImportedKeys(space, owner, name), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"), reverse=True)}
            escape = meta.getSearchStringEscape()
            pattern = name.replace("_", escape + "_").replace("%", escape + "%")
            for column, _ in sorted(_rows(meta.getColumns(space, owner, pattern, "%"), "COLUMN_NAME", "ORDINAL_POSITION"), key=lambda r: int(r[1])):
                place += 1
                rows.append((owner or of, name, place, column, column in keys, column in foreign, *foreign.get(column, (None, None)), keys.get(column)))
    return spark.createDataFrame(rows, CATALOG)


def choose_tables(catalog: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The catalog's rows of the tables named, by bare name or schema.table; without a list, or
    with an empty one, of those with a primary key."""
    if wanted:
        return catalog.where(F.col("table").isin(wanted) | F.concat_ws(".", "schema", "table").isin(wanted))
    keyed = catalog.where("is_pk").select("schema", "table").distinct()
    return catalog.join(F.broadcast(keyed), ["schema", "table"], "left_semi")  # a row per table of the schema


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """The foreign keys with the role (RAW-14) of their table, as MAP-8 takes them."""
    keys = catalog.where("is_fk").select("table", "place", "column", "referenced_table", "referenced_column")
    return keys.join(classify_tables(catalog), "table")


def _literal(value, kind: str) -> str:
    """A key as it stands in a statement; dates and times in JDBC's own form, which every driver knows."""
    if kind in ("string", "date", "timestamp"):
        text = "'" + str(value).replace("'", "''") + "'"
        return text if kind == "string" else f"{{{'d' if kind == 'date' else 'ts'} {text}}}"
    return str(value)


def _borders(spark: SparkSession, url: str, table: str, key: str, parts: int, properties: dict[str, str]) -> list:
    """Keys that cut a table into parts of equally many rows, read along the key's index; these are its own keys, so gaps and hot ranges don't matter."""
    def ask(query: str):
        rows = spark.read.format("jdbc").options(url=url, query=query, **properties).load().collect()  # one row
        return rows[0][0] if rows else None

    n = ask(f"SELECT count(*) AS n FROM {table}")
    skip = "LIMIT 1 OFFSET {0}" if url.startswith(("jdbc:mysql", "jdbc:mariadb")) else "OFFSET {0} ROWS FETCH NEXT 1 ROWS ONLY"
    found = [ask(f"SELECT {key} FROM {table} ORDER BY {key} " + skip.format(n * k // parts)) for k in range(1, parts) if n * k // parts > n * (k - 1) // parts]
    return list(dict.fromkeys(b for b in found if b is not None))  # in the order of the database, whose collation isn't ours


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str | None, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table (quoted as the database wants it) in parts by ranges of its key, whose type may be
    a number, text, date or timestamp; without a key, or with another type, in one part.

    A part's range is a predicate that the database answers from its index; filters and
    columns of later steps are pushed into the same statement, as read_increment's (SRC-3).
    """
    properties = properties or {}
    whole = spark.read.jdbc(url, table, properties=properties)
    if key is None:
        return whole
    kind = whole.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "decimal", "string", "varchar", "char", "date", "timestamp"):
        return whole
    kind = "string" if kind in ("varchar", "char") else kind
    with connect(spark, url, properties) as c:
        mark = c.getMetaData().getIdentifierQuoteString().strip()
    name = f"{mark}{key}{mark}"
    cuts = [_literal(b, kind) for b in _borders(spark, url, table, name, parts, properties)]
    if not cuts:
        return whole
    ranges = [f"{name} < {cuts[0]}", *[f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:])], f"{name} >= {cuts[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=properties)


def read_jdbc_tables(spark: SparkSession, url: str, wanted: list[str] | None = None, schema: str | None = None, parts: int = 8, properties: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The chosen tables by name, and their catalog. A name that two schemas have is schema.table.

    Each table is cut by the first column of its primary key; one without a key is one part."""
    catalog = choose_tables(read_catalog(spark, url, schema, properties), wanted)
    first = catalog.groupBy("schema", "table").agg(F.min_by("column", "key_place").alias("key")).collect()  # a row per table of the schema
    with connect(spark, url, properties) as c:
        mark = c.getMetaData().getIdentifierQuoteString().strip()
    names = [r.table for r in first]
    out = {}
    for r in first:
        quoted = ".".join(f"{mark}{x.replace(mark, mark * 2) if mark else x}{mark}" for x in (r.schema, r.table) if x)
        out[r.table if names.count(r.table) == 1 else f"{r.schema}.{r.table}"] = read_jdbc_table(spark, url, quoted, r.key, parts, properties)
    return out, catalog
