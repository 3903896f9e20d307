"""Numeric helpers: rounding, shares and reading counts out of free results."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal literals as a result cell may spell them; anything else is no number.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def one_decimal(value: Column) -> Column:
    """Round to one decimal on the exact binary value, ties to even."""
    return one_decimal_text(value).cast("double")


def one_decimal_text(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.0"))


def whole_text(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def share_pct(part: Column, whole: Column, default: float = 0.0) -> Column:
    """`part / whole * 100`, or `default` when the whole is unknown or zero."""
    pct = part / F.when(whole > 0, whole) * F.lit(100.0)
    return F.coalesce(pct, F.lit(default))


def score_pct(ok: Column, total: Column, empty: float) -> Column:
    """Score rounded to one decimal; `empty` where nothing was counted."""
    return F.when(total > 0, one_decimal(ok / total * F.lit(100.0))).otherwise(F.lit(empty))


def to_long_or(value: Column, dtype: T.DataType, default: int | None = 0) -> Column:
    """Read a count from a result of any type, truncating toward zero.

    Text that is no number, NULL and empty lists give `default`; a list gives
    its first cell, at any nesting depth.
    """
    fallback = F.lit(default).cast("bigint")
    if isinstance(dtype, T.ArrayType):
        first = F.try_element_at(value, F.lit(1))
        return to_long_or(first, dtype.elementType, default)
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return fallback
        head = dtype.fields[0]
        return to_long_or(value.getField(head.name), head.dataType, default)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value.cast("int").cast("bigint"), fallback)
    if isinstance(dtype, T.NumericType):
        return F.coalesce(value.try_cast("bigint"), fallback)
    if isinstance(dtype, T.StringType):
        number = F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double"))
        return F.coalesce(number.try_cast("bigint"), fallback)
    return fallback
