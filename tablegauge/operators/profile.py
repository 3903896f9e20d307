"""Column profiles.

Counts, extremes and the name-driven validity counts of a table come from one
scan, split in two aggregates by column type. Exact distinct counts come from further passes of a
few columns each: a pass expands every row once per column, so few columns keep
the expanded rows narrow, and column pruning keeps the bytes read in total
close to one more scan.
"""

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.numbers import one_decimal_text, share_pct
from tablegauge.functions.text import (
    group_key_sql,
    or_missing,
    shorten,
    value_shape,
)
from tablegauge.schemas import CHECK_LOG, COLUMN_PROFILE
from tablegauge.sources.tables import Tables

# Column names and patterns that call for a validity rule.
EMAIL_NAME = "email"
EMAIL_LIKE = "%_@_%._%"
NON_NEGATIVE_NAMES = ("amount", "price", "qty", "quantity", "total")
# Fragments of free-text type names that mean a number.
NUMERIC_HINTS = ("int", "num", "real", "dec", "float", "double", "money")

# Standard error of a distinct count by sketch.
SKETCH_ERROR = 0.05
# Names that always call for uniqueness.
KEY_NAMES = ("id", "sku", "code")

_KEYS = ("table_name", "ordinal", "column_name", "dtype", "nullable")
_FLAT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_SPARK_NUMERIC = r"^(tinyint|smallint|int|bigint|float|double|decimal\(.*\))$"


class Field(NamedTuple):
    """A column with its place in the profile."""

    ordinal: int
    column: T.StructField
    nullable: bool


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by halves: each frame is analysed again once per level, not once per frame."""
    listed = list(frames)
    while len(listed) > 1:
        pairs = zip(listed[::2], listed[1::2])
        odd = listed[-1:] if len(listed) % 2 else []
        listed = [a.unionByName(b) for a, b in pairs] + odd
    return listed[0]


def numeric_dtype(dtype: Column) -> Column:
    """Whether a Spark type name is numeric."""
    return dtype.rlike(_SPARK_NUMERIC)


def numeric_hint(dtype: Column) -> Column:
    """Whether a type name from a database catalogue looks numeric."""
    name = F.lower(F.coalesce(dtype, F.lit("")))
    return reduce(lambda a, b: a | b, [name.contains(h) for h in NUMERIC_HINTS])


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType, T.CalendarIntervalType))


def _countable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.VariantType, T.CalendarIntervalType))


def _sketchable(dtype: T.DataType) -> bool:
    return _countable(dtype) and not isinstance(dtype, T.MapType)


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def _fraction(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def col(name: str) -> Column:
    """Refer to a column by its plain name, whatever characters it holds."""
    return F.col(ident(name))


def wants_email(name: str) -> bool:
    return EMAIL_NAME in name.lower()


def wants_non_negative(name: str, dtype: T.DataType) -> bool:
    if wants_email(name) or not isinstance(dtype, T.NumericType):
        return False
    return any(part in name.lower() for part in NON_NEGATIVE_NAMES)


def email_miss(value: Column) -> Column:
    text = value.cast("string")
    return value.isNotNull() & ~text.like(EMAIL_LIKE)


def _null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Aggregates are given as SQL text: a wide schema has hundreds of them, and one
# call per table hands them all over.
def _base_metrics(field: T.StructField, rsd: float | None) -> dict[str, str]:
    """Aggregates of one column, by profile field."""
    value, dtype = ident(field.name), field.dataType
    metrics = {"null_count": f"count_if({value} IS NULL)"}
    if isinstance(dtype, T.NumericType):
        exact = f"{value} + 0.0D" if _fraction(dtype) else value
        metrics["min_num"] = f"CAST(min({exact}) AS DOUBLE)"
        metrics["max_num"] = f"CAST(max({exact}) AS DOUBLE)"
    if _orderable(dtype) and not _fraction(dtype):
        metrics["min_str"] = f"CAST(min({value}) AS STRING)"
        metrics["max_str"] = f"CAST(max({value}) AS STRING)"
    if _is_text(dtype):
        metrics["blank_count"] = f"count_if(trim({value}) = '')"
    if wants_email(field.name):
        metrics["miss_count"] = (
            f"count_if({value} IS NOT NULL AND CAST({value} AS STRING) NOT LIKE '{EMAIL_LIKE}')"
        )
    if wants_non_negative(field.name, dtype):
        metrics["negative_count"] = f"count_if({value} < 0)"
    if rsd is not None and _sketchable(dtype):
        metrics["distinct_count"] = f"approx_count_distinct({value}, {rsd})"
    return metrics


_METRIC_TYPE = {
    f.name: f.dataType.simpleString() for f in COLUMN_PROFILE.fields if f.name not in _KEYS
}


def _long(
    df: DataFrame,
    table_name: str,
    fields: Sequence[Field],
    metrics: Mapping[int, Mapping[str, str]],
    rows: str | None,
) -> DataFrame:
    """Compute aggregates in one go and give one row per column."""
    aggregates = [f"{rows} AS row_count"] if rows else []
    structs = []
    for field in fields:
        built = metrics[field.ordinal]
        aggregates += [f"{agg} AS m{field.ordinal}_{name}" for name, agg in built.items()]
        cells = [
            f"'table_name', {_text(table_name)}",
            f"'ordinal', {field.ordinal}",
            f"'column_name', {_text(field.column.name)}",
            f"'dtype', {_text(field.column.dataType.simpleString())}",
            f"'nullable', {str(field.nullable).lower()}",
        ]
        for name, type_name in _METRIC_TYPE.items():
            if name in built:
                cell = f"m{field.ordinal}_{name}"
            elif name == "row_count" and rows:
                cell = "row_count"
            else:
                cell = f"CAST(NULL AS {type_name})"
            cells.append(f"'{name}', {cell}")
        structs.append(f"named_struct({', '.join(cells)})")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(structs)}))")


def base_profile(
    df: DataFrame, table_name: str, fields: Sequence[Field], rsd: float | None
) -> list[DataFrame]:
    """Every metric that needs no grouping; each column is read once.

    Extremes of text and nested values keep Spark from aggregating in place, so
    those columns have a pass of their own and do not slow down the others.
    """
    flat = [f for f in fields if isinstance(f.column.dataType, _FLAT)]
    other = [f for f in fields if f not in flat]
    return [
        _long(df, table_name, part, {f.ordinal: _base_metrics(f.column, rsd) for f in part}, "count(1)")
        for part in (flat, other)
        if part
    ]


def exact_distinct(
    df: DataFrame, table_name: str, fields: Sequence[Field], columns_per_pass: int
) -> list[DataFrame]:
    """Exact distinct counts, a few columns to a pass; NULL is not counted."""
    countable = [f for f in fields if _countable(f.column.dataType)]
    passes = []
    for start in range(0, len(countable), columns_per_pass):
        batch = countable[start : start + columns_per_pass]
        metrics = {
            f.ordinal: {
                "distinct_count": "count(DISTINCT "
                f"{group_key_sql(ident(f.column.name), f.column.dataType)})"
            }
            for f in batch
        }
        passes.append(_long(df, table_name, batch, metrics, None))
    return passes


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The `k` most frequent values of each column, ties by value.

    Counting happens before the shuffle, and every task passes on only its own
    first `k` groups, so neither a hot value nor a near-unique column piles up.
    """
    frames = []
    for name in columns:
        dtype = df.schema[name].dataType
        value = col(name) + F.lit(0.0) if _fraction(dtype) else col(name)
        kept = df.where(col(name).isNotNull())
        if _is_text(dtype):
            # Long text is grouped by its digest; one copy of each text is carried along.
            groups = kept.groupBy(F.expr(group_key_sql(ident(name), dtype)).alias("key")).agg(
                F.count(F.lit(1)).alias("n"), F.any_value(value).alias("v")
            )
        else:
            groups = kept.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        counted = groups.orderBy(F.desc("n"), F.asc("v")).limit(k)
        # At most k rows are left here.
        packed = counted.agg(F.collect_list(F.struct((-F.col("n")).alias("o"), "v")).alias("l"))
        ranked = packed.select(F.posexplode(F.array_sort("l")).alias("pos", "e"))
        frames.append(
            ranked.select(
                F.lit(name).alias("column_name"),
                (F.col("pos") + 1).alias("rank"),
                F.col("e.v").cast("string").alias("value"),
                (-F.col("e.o")).alias("n"),
            )
        )
    return union_all(frames)


def _top_part(df: DataFrame, table_name: str, fields: Sequence[Field], k: int) -> DataFrame:
    """Top values as a profile part; a list holds at most `k` entries."""
    by_name = {f.column.name: f for f in fields}
    packed = (
        top_values(df, list(by_name), k)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    )
    keys = [F.lit(x) for f in fields for x in (f.column.name, f.ordinal)]
    types = [F.lit(x) for f in fields for x in (f.column.name, f.column.dataType.simpleString())]
    open_to_null = [F.lit(x) for f in fields for x in (f.column.name, f.nullable)]
    found = packed.select(
        F.lit(table_name).alias("table_name"),
        F.create_map(*keys)[F.col("column_name")].alias("ordinal"),
        "column_name",
        F.create_map(*types)[F.col("column_name")].alias("dtype"),
        F.create_map(*open_to_null)[F.col("column_name")].alias("nullable"),
        F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(
            "top_values"
        ),
    )
    blank = {m: _null(t) for m, t in _METRIC_TYPE.items() if m != "top_values"}
    return found.withColumns(blank)


def _profile_parts(
    df: DataFrame,
    table_name: str,
    *,
    mode: str = "exact",
    rsd: float = SKETCH_ERROR,
    columns: Sequence[str] | None = None,
    not_null: Iterable[str] = (),
    top_k: int = 0,
    top_columns: Sequence[str] | None = None,
    columns_per_pass: int = 4,
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Base parts, each with columns of its own, and parts that add to them."""
    if mode not in ("exact", "approx", "none"):
        raise ValueError(f"unknown profile mode {mode!r}")
    schema, declared = df.schema, set(not_null)
    fields = [
        Field(i, schema[name], schema[name].nullable and name not in declared)
        for i, name in enumerate(columns if columns is not None else schema.names, start=1)
    ]
    base = base_profile(df, table_name, fields, rsd if mode == "approx" else None)
    more = []
    if mode == "exact":
        more += exact_distinct(df, table_name, fields, columns_per_pass)
    if top_k:
        wanted = set(top_columns) if top_columns is not None else set(schema.names)
        shown = [f for f in fields if f.column.name in wanted and _orderable(f.column.dataType)]
        more.append(_top_part(df, table_name, shown, top_k))
    return base, more


def _merge(base: Sequence[DataFrame], more: Sequence[DataFrame]) -> DataFrame:
    """Bring the parts of each column together; every metric has one source."""
    merged = union_all((*base, *more))
    if more:
        merged = merged.groupBy(*_KEYS).agg(
            *(F.any_value(m, ignoreNulls=True).alias(m) for m in _METRIC_TYPE)
        )
    return merged.select(*COLUMN_PROFILE.fieldNames())


def profile_table(df: DataFrame, table_name: str, **options: object) -> DataFrame:
    """Profile of one table, one row per column.

    Options: `mode` is `exact`, `approx` (distinct counts by sketch with
    relative error `rsd`, all in the one scan) or `none` (no distinct counts);
    `columns` restricts and orders the columns; `not_null` names columns
    declared NOT NULL; `top_k` adds the most frequent values of all or of
    `top_columns`; `columns_per_pass` sets how many columns one pass of exact
    distinct counts takes.
    """
    return _merge(*_profile_parts(df, table_name, **options))


def exact_where_close(
    df: DataFrame, column_profile: DataFrame, rsd: float, columns_per_pass: int = 4
) -> DataFrame:
    """A profile by sketch with exact distinct counts where uniqueness could hang on them.

    These are columns with a key's name and columns whose sketch lies within four
    standard errors of the rows. One row per column reaches the driver.
    """
    near = F.abs(F.col("row_count") - F.col("distinct_count")) <= 4 * rsd * F.col("row_count")
    named = F.lower("column_name").isin(*KEY_NAMES)
    rows = column_profile.where(F.col("distinct_count").isNotNull() & (near | named)).collect()
    if not rows:
        return column_profile
    fields = [Field(r.ordinal, df.schema[r.column_name], r.nullable) for r in rows]
    passes = exact_distinct(df, rows[0].table_name, fields, columns_per_pass)
    exact = union_all(passes).select("ordinal", F.col("distinct_count").alias("exact"))
    return (
        column_profile.join(exact, "ordinal", "left")
        .withColumn("distinct_count", F.coalesce("exact", "distinct_count"))
        .select(*COLUMN_PROFILE.fieldNames())
    )


def profile_schema(
    tables: Tables,
    *,
    not_null: Mapping[str, Iterable[str]] | None = None,
    **options: object,
) -> DataFrame:
    """Profiles of all tables in one frame; the tables' jobs run side by side."""
    declared = not_null or {}
    base, more = [], []
    for name, df in sorted(tables.items()):
        first, rest = _profile_parts(df, name, not_null=declared.get(name, ()), **options)
        base += first
        more += rest
    return _merge(base, more)


def null_shares(column_profile: DataFrame) -> DataFrame:
    """Null percentage of each column and its band."""
    pct = share_pct(F.col("null_count"), F.col("row_count"))
    band = F.when(pct == 0, "success").when(pct < 15, "warning").otherwise("danger")
    return column_profile.select(
        "table_name",
        "column_name",
        "null_count",
        one_decimal_text(pct).alias("null_pct"),
        band.alias("band"),
    )


def pattern_stats(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The `k` most frequent value shapes of each text column."""
    shapes = df.select(*(value_shape(col(c)).alias(c) for c in columns))
    return top_values(shapes, columns, k)


def profile_plan_size(manifest: DataFrame, spark_types: bool = True) -> DataFrame:
    """Number of profile statements of each table.

    `spark_types=False` reads type names as a database catalogue spells them.
    """
    numeric = numeric_dtype(F.col("dtype")) if spark_types else numeric_hint(F.col("dtype"))
    return manifest.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(numeric).alias("numeric_columns"),
        (1 + 2 * F.count(F.lit(1)) + F.count_if(numeric)).alias("statements"),
    )


def profile_statements(
    manifest: DataFrame, status: str = "executed", spark_types: bool = True
) -> DataFrame:
    """The metrics of a profile as log rows, one statement each.

    `spark_types=False` reads type names as a database catalogue spells them.
    """
    numeric = numeric_dtype(F.col("dtype")) if spark_types else numeric_hint(F.col("dtype"))
    table, name = F.col("table_name"), F.col("column_name")
    source = F.concat(F.lit("`"), table, F.lit("`"))
    quoted = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))

    def statement(purpose: str, text: Column, column: Column = name) -> Column:
        sql_id = F.concat_ws(".", table, F.lit(purpose), column)
        return F.struct(
            sql_id.alias("sql_id"),
            F.lit(purpose).alias("purpose"),
            column.alias("column_name"),
            text.alias("sql_text"),
        )

    items = F.array(
        F.when(
            F.col("ordinal") == 1,
            statement(
                "row_count", F.concat(F.lit("SELECT COUNT(*) FROM "), source), _null("string")
            ),
        ),
        statement(
            "null_count",
            F.concat(
                F.lit("SELECT COUNT(*) FROM "), source, F.lit(" WHERE "), quoted,
                F.lit(" IS NULL"),
            ),
        ),
        statement(
            "distinct",
            F.concat(F.lit("SELECT COUNT(DISTINCT "), quoted, F.lit(") FROM "), source),
        ),
        F.when(
            numeric,
            statement(
                "min_max",
                F.concat(
                    F.lit("SELECT MIN("), quoted, F.lit("), MAX("), quoted, F.lit(") FROM "),
                    source,
                ),
            ),
        ),
    )
    listed = manifest.select(
        "table_name", F.inline(F.filter(items, lambda x: x.isNotNull()))
    )
    return listed.select(
        "table_name",
        "sql_id",
        "purpose",
        "column_name",
        "sql_text",
        F.lit(status).alias("status"),
        F.lit(0).alias("attempts"),
        _null("string").alias("last_error"),
        _null("string").alias("error_class"),
        F.array().cast("array<string>").alias("fix_history"),
    ).select(*CHECK_LOG.fieldNames())


def column_profile_report(column_profile: DataFrame, width: int = 40) -> DataFrame:
    """Profile rows as printed: text cells, `—` where nothing is known."""
    rows, nulls = F.col("row_count"), F.col("null_count")
    pct = (
        F.when(nulls.isNotNull() & (rows > 0), share_pct(nulls, rows))
        .when(nulls == 0, F.lit(0.0))
    )
    sample = F.when(
        F.size("top_values") > 0,
        F.array_join(
            F.transform("top_values", lambda s: F.concat(s["value"], F.lit(" ("), s["n"], F.lit(")"))),
            ", ",
        ),
    )
    return column_profile.select(
        "table_name",
        "ordinal",
        "column_name",
        "dtype",
        F.when(F.col("nullable"), "YES").otherwise("NO").alias("nullable"),
        or_missing(nulls).alias("null_count"),
        F.coalesce(F.concat(one_decimal_text(pct), F.lit("%")), or_missing(_null("string"))).alias(
            "null_pct"
        ),
        or_missing(F.col("distinct_count")).alias("distinct_count"),
        or_missing(F.coalesce("min_str", F.format_string("%.4f", "min_num"))).alias("min_value"),
        or_missing(F.coalesce("max_str", F.format_string("%.4f", "max_num"))).alias("max_value"),
        or_missing(shorten(sample, width)).alias("top_sample"),
    )
