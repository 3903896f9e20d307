"""Column profiles of growing tables: every part of a table is read once and its summary kept.

A part is whatever has one value of the part column, such as a day's partition. Its summary
is one row with counts, extremes and a distinct-count sketch of every column; summaries
add up, so a profile of the whole table needs no part again that has not changed.
"""

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.profile import (
    EMAIL_LIKE,
    Field,
    _fraction,
    _is_text,
    _long,
    _orderable,
    col,
    exact_where_close,
    ident,
    wants_email,
    wants_non_negative,
)
from tablegauge.schemas import COLUMN_PROFILE

#: Sketches have 2 to this power registers; the standard error follows from it.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: Changed parts up to which they are named in the filter of the scan, which prunes partitions.
NAMED_PARTS = 1000


def _sketch_input(name: str, dtype: T.DataType) -> str | None:
    """The column as a type that sketches take: equal values stay equal, others apart."""
    value = ident(name)
    if isinstance(dtype, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return value
    if isinstance(dtype, (T.ByteType, T.ShortType, T.BooleanType)):
        return f"CAST({value} AS INT)"
    if isinstance(dtype, T.DateType):
        return f"unix_date({value})"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({value})"
    if _fraction(dtype):
        return f"CAST(CAST({value} AS DOUBLE) + 0.0D AS STRING)"
    if isinstance(dtype, (T.DecimalType, T.TimestampNTZType)):
        return f"CAST({value} AS STRING)"
    return None


def _measures(field: Field) -> dict[str, tuple[str, str]]:
    """Per measure of a column the aggregate over a part's rows, and that over parts."""
    name, dtype = field.column.name, field.column.dataType
    value, n = ident(name), field.ordinal
    out = {"null_count": (f"count_if({value} IS NULL)", "coalesce(sum({}), 0)")}
    if _orderable(dtype):
        exact = f"{value} + 0.0D" if _fraction(dtype) else value
        out["min"] = (f"min({exact})", "min({})")
        out["max"] = (f"max({exact})", "max({})")
    if _is_text(dtype):
        out["blank_count"] = (f"count_if(trim({value}) = '')", "coalesce(sum({}), 0)")
    if wants_email(name):
        out["miss_count"] = (
            f"count_if({value} IS NOT NULL AND CAST({value} AS STRING) NOT LIKE '{EMAIL_LIKE}')", "coalesce(sum({}), 0)"
        )
    if wants_non_negative(name, dtype):
        out["negative_count"] = (f"count_if({value} < 0)", "coalesce(sum({}), 0)")
    sketched = _sketch_input(name, dtype)
    if sketched:
        out["sketch"] = (f"hll_sketch_agg({sketched}, {SKETCH_BITS})", "coalesce(hll_sketch_estimate(hll_union_agg({})), 0)")
    return {measure: (part, whole.format(f"c{n}_{measure}")) for measure, (part, whole) in out.items()}


def _fields(df: DataFrame, part: str, not_null: Iterable[str]) -> list[Field]:
    declared = set(not_null)
    return [
        Field(i, f, f.nullable and f.name not in declared)
        for i, f in enumerate((f for f in df.schema.fields if f.name != part), start=1)
    ]


def part_summaries(df: DataFrame, part: str) -> DataFrame:
    """One row for each part: its rows, and counts, extremes and sketches of all other columns."""
    wanted = ["count(1) AS row_count"]
    for field in _fields(df, part, ()):
        wanted += [f"{agg} AS c{field.ordinal}_{measure}" for measure, (agg, _) in _measures(field).items()]
    return df.groupBy(col(part).alias("part")).agg(*[F.expr(w) for w in wanted])


def merged_profile(parts: DataFrame, df: DataFrame, table_name: str, part: str, not_null: Iterable[str] = ()) -> DataFrame:
    """The profile of the whole table from its parts' summaries, distinct counts by sketch."""
    metrics = {}
    for field in _fields(df, part, not_null):
        dtype, built = field.column.dataType, {m: whole for m, (_, whole) in _measures(field).items()}
        for end in ("min", "max"):
            agg = built.pop(end, None)
            if agg and isinstance(dtype, T.NumericType):
                built[f"{end}_num"] = f"CAST({agg} AS DOUBLE)"
            if agg and not _fraction(dtype):
                built[f"{end}_str"] = f"CAST({agg} AS STRING)"
        if "sketch" in built:
            built["distinct_count"] = built.pop("sketch")
        metrics[field.ordinal] = built
    found = _long(parts, table_name, _fields(df, part, not_null), metrics, "coalesce(sum(row_count), 0)")
    return found.select(*COLUMN_PROFILE.fieldNames())


def _stored(df: DataFrame, root: str) -> DataFrame | None:
    """The newest summary of every part under a path."""
    spark = df.sparkSession
    try:
        found = spark.read.parquet(root)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    newest = found.groupBy("part").agg(F.max("seq").alias("seq")).withColumnRenamed("part", "p")
    same = found["part"].eqNullSafe(newest["p"]) & (found["seq"] == newest["seq"])
    return found.join(newest, same, "left_semi")


def refresh_parts(df: DataFrame, part: str, root: str, again: Sequence[object] = ()) -> int:
    """Bring the summaries under `root` up to date; returns how many parts were read.

    Read are parts that are new, have another number of rows than before, or are named in
    `again`. Numbers of rows come from a scan of the part column alone, which for partition
    folders reads file footers only. New summaries are appended in one job, so after a failure the old
    ones hold. Up to `NAMED_PARTS` values of changed parts reach the driver; beyond, they are joined.
    """
    sizes = df.groupBy(col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows_now"))
    known, seq = _stored(df, root), 0
    changed = sizes
    if known is not None:
        seq = known.agg(F.max("seq")).first()[0] or 0
        before = known.select(F.col("part").alias("p"), F.col("row_count").alias("rows_before"))
        met = sizes.join(before, sizes["part"].eqNullSafe(before["p"]), "left")
        stale = ~F.col("rows_now").eqNullSafe(F.col("rows_before"))
        for value in again:
            stale = stale | F.col("part").eqNullSafe(F.lit(value))
        changed = met.where(stale).select("part")
    else:
        changed = sizes.select("part")
    few = [r.part for r in changed.limit(NAMED_PARTS + 1).collect()]
    if not few:
        return 0
    if len(few) <= NAMED_PARTS:
        hit = col(part).isin([v for v in few if v is not None])
        rows = df.where((hit | col(part).isNull()) if None in few else hit)
        n = len(few)
    else:
        rows = df.join(changed, col(part).eqNullSafe(changed["part"]), "left_semi")
        n = changed.count()
    part_summaries(rows, part).withColumn("seq", F.lit(seq + 1)).write.mode("append").parquet(root)
    return n


def incremental_profile(
    df: DataFrame,
    table_name: str,
    part: str,
    root: str,
    *,
    not_null: Iterable[str] = (),
    exact: bool = True,
    again: Sequence[object] = (),
) -> DataFrame:
    """The profile of a table that grows by parts; only new and changed parts are read in full.

    With `exact`, columns whose uniqueness hangs on more than the sketch tells are counted
    exactly, one by one, over the whole table. Parts that the table no longer has do not count.
    """
    refresh_parts(df, part, root, again)
    known = _stored(df, root)
    if known is None:
        known = part_summaries(df, part)
    else:
        present = df.select(col(part).alias("now")).distinct()
        known = known.join(present, known["part"].eqNullSafe(present["now"]), "left_semi")
    found = merged_profile(known, df, table_name, part, not_null)
    return exact_where_close(df, found, SKETCH_ERROR) if exact else found
