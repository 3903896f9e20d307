"""User metrics: expressions fused into one scan, or statements of their own."""

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tablegauge.functions.numbers import to_long_or
from tablegauge.operators.checks import (
    PARALLEL_UNITS,
    ReadOnlyViolation,
    UnknownCheck,
    brief,
    error_class_of,
    lint_statements,
)
from tablegauge.operators.profile import union_all
from tablegauge.schemas import METRIC_RESULTS
from tablegauge.sources.storage import run_folder
from tablegauge.sources.tables import Tables, named_views

_TEXT = "string"


def _cells(names: Sequence[str]) -> Column:
    return F.array(*(F.col(n).cast(_TEXT) for n in names))


def _shape(df: DataFrame, spec: dict, seq: int, cells: Column) -> DataFrame:
    return df.select(
        F.lit(spec["table_name"]).alias("table_name"),
        F.lit(spec["sql_id"]).alias("sql_id"),
        F.lit(spec["purpose"]).alias("purpose"),
        F.lit(spec["column_name"]).cast(_TEXT).alias("column_name"),
        F.lit(seq).alias("seq"),
        F.lit("executed").alias("status"),
        cells.alias("cells"),
        F.lit(None).cast(_TEXT).alias("error_class"),
        F.lit(None).cast(_TEXT).alias("last_error"),
    )


def _fused(df: DataFrame, specs: Sequence[tuple[int, dict]]) -> DataFrame:
    one = df.agg(*(F.expr(s["expr"]).alias(f"m{seq}") for seq, s in specs))
    rows = [
        F.struct(
            F.lit(s["table_name"]).alias("table_name"),
            F.lit(s["sql_id"]).alias("sql_id"),
            F.lit(s["purpose"]).alias("purpose"),
            F.lit(s["column_name"]).cast(_TEXT).alias("column_name"),
            F.lit(seq).alias("seq"),
            F.lit("executed").alias("status"),
            F.array(F.col(f"m{seq}").cast(_TEXT)).alias("cells"),
            F.lit(None).cast(_TEXT).alias("error_class"),
            F.lit(None).cast(_TEXT).alias("last_error"),
        )
        for seq, s in specs
    ]
    return one.select(F.inline(F.array(*rows)))


def custom_metrics(tables: Tables, specs: Sequence[Row | dict]) -> DataFrame:
    """Metric results: one row per metric, or per result row for `top_values`.

    A metric gives `expr`, an aggregate expression over its table, or
    `sql_text`, a query over the tables by name; of a query other than
    `top_values` only the first row counts. A metric that does not resolve, or
    is no read-only query, or fails while running is reported as `failed`. Results
    are stored once; expressions run by themselves only where their table's common
    scan fails.
    """
    spark = next(iter(tables.values())).sparkSession
    specs = [s.asDict() if isinstance(s, Row) else dict(s) for s in specs]
    texts = {i: s.get("sql_text") or "" for i, s in enumerate(specs) if not s.get("expr")}
    lint = lint_statements(spark, texts)
    fused: dict[str, list[tuple[int, dict]]] = {}
    single: list[tuple[DataFrame, list[tuple[int, dict]]]] = []
    failures: list[tuple] = []
    root, written = run_folder(spark, "metrics"), []

    def refuse(seq: int, spec: dict, error: Exception) -> None:
        failures.append(
            (
                spec["table_name"], spec["sql_id"], spec["purpose"], spec["column_name"],
                seq, "failed", None, error_class_of(error), brief(error),
            )
        )

    def run(unit: tuple[DataFrame, list[tuple[int, dict]]]) -> None:
        frame, group = unit
        path = f"{root}/{group[0][0]}-{len(group)}"
        try:
            frame.select(*METRIC_RESULTS.fieldNames()).write.mode("overwrite").parquet(path)
            written.append(path)
        except PySparkException as error:
            if len(group) == 1:
                refuse(*group[0], error)
                return
            for seq, spec in group:
                run((_fused(tables[spec["table_name"]], [(seq, spec)]), [(seq, spec)]))

    for seq, spec in enumerate(specs):
        try:
            if spec["table_name"] not in tables:
                raise UnknownCheck(f"no table named {spec['table_name']}")
            if spec.get("expr"):
                tables[spec["table_name"]].agg(F.expr(spec["expr"]))
                fused.setdefault(spec["table_name"], []).append((seq, spec))
                continue
            if lint[seq] != "ok":
                raise ReadOnlyViolation(f"statement refused by the read-only lint: {lint[seq]}")
            with named_views(tables):
                found = spark.sql(spec["sql_text"])
            found = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
            if spec["purpose"] != "top_values":
                found = found.limit(1)
            single.append((_shape(found, spec, seq, _cells(found.columns)), [(seq, spec)]))
        except (PySparkException, ValueError) as error:
            refuse(seq, spec, error)
    units = single + [(_fused(tables[t], group), group) for t, group in fused.items()]
    with ThreadPoolExecutor(max_workers=PARALLEL_UNITS) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), units))
    frames = [spark.createDataFrame(failures, METRIC_RESULTS)] if failures or not written else []
    if written:
        frames.append(spark.read.schema(METRIC_RESULTS).parquet(*sorted(written)))
    return union_all(frames).select(*METRIC_RESULTS.fieldNames())


def summarise_metrics(results: DataFrame, k: int | None = None) -> DataFrame:
    """Profile summary per table and column from executed metric results.

    Of several results for one purpose the last one counts. `min_max` may come
    as two cells or one; `top_values` rows are `(value, n)`, all of which the
    summary shows, or the first `k`. A table with nothing but a row count has a row
    without a column.
    """
    done = results.where(F.col("status") == "executed")
    first = F.try_element_at("cells", F.lit(1))
    second = F.try_element_at("cells", F.lit(2))
    cell_type = results.schema["cells"].dataType.elementType
    count = to_long_or(first, cell_type, None)
    pair = F.size("cells") >= 2
    ranges = F.col("purpose").isin("min_max", "min", "max")

    def latest(value: Column, fits: Column) -> Column:
        return F.max_by(value, F.when(fits, F.col("seq")))

    def counted(purpose: str) -> Column:
        return latest(count, F.col("purpose") == purpose)

    rows = (
        done.where(F.col("purpose") == "row_count")
        .groupBy("table_name")
        .agg(F.max_by(count, "seq").alias("row_count"))
    )
    of_columns = done.where((F.col("purpose") != "row_count") & F.col("column_name").isNotNull())
    columns = of_columns.groupBy("table_name", "column_name").agg(
        counted("null_count").alias("null_count"),
        counted("distinct").alias("distinct_count"),
        latest(first, ranges & pair).alias("min_value"),
        latest(second, ranges & pair).alias("max_value"),
        latest(first, ranges & ~pair).alias("min_max"),
        counted("blank_count").alias("blank_count"),
    )
    order = W.partitionBy("table_name", "column_name").orderBy(
        F.desc("seq"), F.desc("n"), F.asc("value")
    )
    listed = of_columns.where(F.col("purpose") == "top_values").select(
        "table_name", "column_name", "seq", first.alias("value"),
        to_long_or(second, cell_type, None).alias("n"),
    )
    placed = listed.withColumn("place", F.row_number().over(order))
    tops = (
        (placed if k is None else placed.where(F.col("place") <= k))
        .groupBy("table_name", "column_name")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("t"))
        .select(
            "table_name",
            "column_name",
            F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(
                "top_values"
            ),
        )
    )
    return columns.join(tops, ["table_name", "column_name"], "left").join(
        rows, "table_name", "full"
    )
