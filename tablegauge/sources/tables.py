"""Tables of a schema from files, the catalogue or a database."""

import warnings
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.schemas import MANIFEST

Tables = Mapping[str, DataFrame]


def jdbc_options(
    url: str,
    table: str,
    *,
    partition: tuple[str, object, object, int] | None = None,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Reader options of one database table.

    `partition` is `(column, lowest, highest, parts)`; without it the database
    is read over a single connection, which suits small tables only.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition:
        column, low, high, parts = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(parts),
        }
    else:
        warnings.warn(f"{table}: read over one connection; give `partition` for large tables", stacklevel=2)
    return options


def discovery_query(url: str, schema: str) -> str:
    """Query listing the columns of the base tables of a database schema."""
    if url.startswith("jdbc:sqlite"):
        return (
            "SELECT '' AS schema_name, t.name AS table_name, c.cid + 1 AS ordinal, "
            "c.name AS column_name, COALESCE(NULLIF(c.type, ''), 'TEXT') AS dtype, "
            'c."notnull" = 0 AS nullable '
            "FROM sqlite_master t JOIN pragma_table_info(t.name) c "
            "WHERE t.type = 'table' AND t.name NOT LIKE 'sqlite_%'"
        )
    literal = schema.replace("'", "''")
    return (
        "SELECT c.table_schema AS schema_name, c.table_name, "
        "c.ordinal_position AS ordinal, c.column_name, c.data_type AS dtype, "
        "CASE WHEN upper(c.is_nullable) = 'YES' THEN 1 ELSE 0 END AS nullable "
        "FROM information_schema.columns c JOIN information_schema.tables t "
        "ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        f"WHERE t.table_type = 'BASE TABLE' AND c.table_schema = '{literal}'"
    )


def discover_jdbc(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """Manifest of a database schema, read from its own catalogue."""
    found = (
        spark.read.format("jdbc")
        .options(url=url, query=discovery_query(url, schema), **options)
        .load()
    )
    found = found.withColumn("row_estimate", F.lit(None))
    return found.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST.fields)
    ).orderBy("table_name", "ordinal")


def load_table(spark: SparkSession, source: Mapping[str, object], name: str) -> DataFrame:
    """One table of a source.

    A source is `{"format": "catalog", "schema": s}`, `{"format": "jdbc",
    "url": u, "schema": s, "partition": {table: (column, low, high, parts)},
    "options": {...}}`, or a file format with `"path"` and, where wanted,
    `"options"`; file tables are read from `<path>/<name>.<format>`.
    """
    kind = str(source["format"])
    options = dict(source.get("options", {}))
    schema = source.get("schema")
    qualified = f"{schema}.{name}" if schema else name
    if kind == "catalog":
        return spark.table(qualified)
    if kind == "jdbc":
        partition = dict(source.get("partition", {})).get(name)
        chosen = jdbc_options(str(source["url"]), qualified, partition=partition, **options)
        return spark.read.format("jdbc").options(**chosen).load()
    return spark.read.format(kind).options(**options).load(f"{source['path']}/{name}.{kind}")


def load_tables(
    spark: SparkSession, source: Mapping[str, object], names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Tables of a source in name order; catalogues and databases list their own."""
    if names is None and source["format"] == "catalog":
        listed = spark.catalog.listTables(source.get("schema"))
        names = [t.name for t in listed if t.tableType not in ("VIEW", "TEMPORARY")]
    elif names is None and source["format"] == "jdbc":
        options = dict(source.get("options", {}))
        found = discover_jdbc(spark, str(source["url"]), str(source.get("schema", "")), **options)
        names = [r.table_name for r in found.select("table_name").distinct().collect()]
    elif names is None:
        raise ValueError("name the tables to read from files")
    return {name: load_table(spark, source, name) for name in sorted(names)}


def row_counts(tables: Tables) -> DataFrame:
    """Exact row count of every table, in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts)


def discover(
    spark: SparkSession,
    tables: Tables,
    schema_name: str = "",
    *,
    not_null: Mapping[str, Iterable[str]] | None = None,
    with_rows: bool = False,
) -> DataFrame:
    """Manifest of the tables: one row per column, in table and column order.

    Files carry no NOT NULL declarations, so `not_null` names such columns.
    """
    declared = {t: set(cols) for t, cols in (not_null or {}).items()}
    rows = [
        (
            schema_name,
            name,
            ordinal,
            field.name,
            field.dataType.simpleString(),
            field.nullable and field.name not in declared.get(name, ()),
            None,
        )
        for name, df in sorted(tables.items())
        for ordinal, field in enumerate(df.schema.fields, start=1)
    ]
    manifest = spark.createDataFrame(rows, MANIFEST)
    if not with_rows or not tables:
        return manifest
    counted = row_counts(tables).withColumnRenamed("row_count", "row_estimate")
    return manifest.drop("row_estimate").join(counted, "table_name", "left").select(
        *MANIFEST.fieldNames()
    )


def pending_tables(manifest: DataFrame, table_states: DataFrame) -> DataFrame:
    """Tables of the manifest that a resumed run still has to work on."""
    done = table_states.where(F.col("stage") == "reviewed").select("table_name")
    return manifest.select("table_name").distinct().join(done, "table_name", "left_anti")


def resume_summary(manifest: DataFrame, table_states: DataFrame) -> DataFrame:
    """Number of tables to work on and of tables skipped."""
    names = manifest.select("table_name").distinct()
    done = (
        table_states.where(F.col("stage") == "reviewed")
        .select("table_name", F.lit(True).alias("done"))
        .distinct()
    )
    return names.join(done, "table_name", "left").agg(
        F.count_if(F.col("done").isNull()).alias("pending"),
        F.count_if(F.col("done").isNotNull()).alias("skipped"),
    )


@contextmanager
def named_views(tables: Tables) -> Iterator[None]:
    """The tables as temporary views of their names while statements are resolved.

    Resolved statements no longer need the views; views of the same names that the
    session had before are put back.
    """
    spark = next(iter(tables.values())).sparkSession
    before = {name: _own_view(spark, name) for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name, view in before.items():
            if view is None:
                spark.catalog.dropTempView(name)
            else:
                view.createOrReplaceTempView(name)


def _own_view(spark: SparkSession, name: str) -> DataFrame | None:
    try:
        return spark.table(name) if spark.catalog.getTable(name).isTemporary else None
    except PySparkException:
        return None
