"""Counts of how the rows of two tables match by key, without meeting them pair by pair."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.text import group_key_sql
from tablegauge.operators.profile import col, ident

#: Comparisons of a child's value with a parent's: whether the smaller side is the child's, and whether equal values count.
COMPARISONS = {"<": (True, False), "<=": (True, True), ">": (False, False), ">=": (False, True)}
WHOLE = T.DecimalType(38, 0)
#: Buckets that keys are counted in, and the rows of a bucket up to which its keys go to one task each.
BUCKETS, HEAVY = 4096, 1_000_000
#: Types of keys that fall into one bucket if they are equal; text only where equal text has equal bytes.
HASHED = (T.IntegralType, T.DecimalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
BINARY = "UTF8_BINARY"


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of two types compare as they do after a union of both columns."""
    times = (T.DateType, T.TimestampType)
    return (
        a == b
        or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))
        or (isinstance(a, times) and isinstance(b, times))
    )


def same_keys(a: T.DataType, b: T.DataType) -> bool:
    """Whether two columns can be grouped together as one key."""
    return a == b or (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType))


def inequality_pairs(
    child: DataFrame,
    column: str,
    value: Column,
    comparison: str,
    parent: DataFrame,
    parent_column: str,
    parent_value: Column,
) -> DataFrame:
    """Pairs of rows with equal keys for which `value comparison parent_value` holds, as one row `violations`.

    Nothing is joined. Both sides are laid out by key and value; every row of the
    larger-valued side then adds the number of rows of the other side before it. Keys are
    first counted in `BUCKETS` buckets. Where a bucket has at most `HEAVY` rows, so has each
    of its keys, and one shuffle by key and one sort are enough. Keys of other buckets are
    cut into ranges, whatever share of the rows they hold on both sides. NULL keys and
    values match nothing.
    """
    child_is_less, ties = COMPARISONS[comparison]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def side(df: DataFrame, key: str, v: Column, less: bool) -> DataFrame:
        counts = (one, none) if less else (none, one)
        rows = df.select(col(key).alias("k"), v.alias("v"), counts[0].alias("less"), counts[1].alias("more"))
        return rows.where("k IS NOT NULL AND v IS NOT NULL")

    rows = side(child, column, value, child_is_less).union(side(parent, parent_column, parent_value, not child_is_less))
    if not isinstance(rows.schema["k"].dataType, HASHED) or getattr(rows.schema["k"].dataType, "collation", BINARY) != BINARY:
        met = _met_in_ranges(rows, ties)
    else:
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)))
        sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        # One list of at most `BUCKETS` numbers, empty where no key is hot.
        heavy = sizes.where(F.col("n") > HEAVY).agg(F.collect_list("bucket")).scalar()
        is_heavy = F.array_contains(heavy, F.col("bucket"))
        met = _met_by_key(placed.where(~is_heavy), ties).unionByName(_met_in_ranges(placed.where(is_heavy), ties))
    return met.agg(F.coalesce(F.sum("met"), F.lit(0)).cast("bigint").alias("violations"))


def _met_by_key(rows: DataFrame, ties: bool) -> DataFrame:
    """Pairs among rows whose keys are of bounded size, as one row `met`: one task goes through a key."""
    # Of equal values the lesser side comes first if they count, else last.
    first = F.desc("less") if ties else F.asc("less")
    before = W.partitionBy("k").orderBy("v", first).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("before", F.sum("less").over(before)).where("more = 1").agg(
        F.sum("before").cast(WHOLE).alias("met")
    )


def _met_in_ranges(rows: DataFrame, ties: bool) -> DataFrame:
    """Pairs among rows whose keys may be of any size, as one row `met`.

    Both sides are counted per key and value. The order is cut into ranges of about equal
    size, so a key with a large share of the rows on both sides spreads over many tasks:
    within a range a running total is enough, and a key that goes on in the next range
    carries one number over.
    """
    cells = rows.groupBy("k", "v").agg(F.sum("less").alias("less"), F.sum("more").alias("more"))
    cut = cells.repartitionByRange("k", "v").withColumn("slice", F.spark_partition_id())
    before = W.partitionBy("slice", "k").orderBy("v").rowsBetween(W.unboundedPreceding, 0 if ties else -1)
    met = cut.withColumn("met", F.col("more").cast(WHOLE) * F.coalesce(F.sum("less").over(before), F.lit(0)))
    parts = met.groupBy("slice", "k").agg(
        F.sum("met").cast(WHOLE).alias("met"), F.sum("less").alias("less"), F.sum("more").alias("more")
    )
    earlier = W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = F.col("more").cast(WHOLE) * F.coalesce(F.sum("less").over(earlier), F.lit(0))
    return parts.withColumn("carried", carried.cast(WHOLE)).agg(
        (F.sum("met") + F.sum("carried")).cast(WHOLE).alias("met")
    )


def key_of(df: DataFrame, column: str) -> Column:
    """The column as a grouping key; long text is stood for by its digest."""
    return F.expr(group_key_sql(ident(column), df.schema[column].dataType))


def key_counts(
    child: DataFrame,
    columns: Sequence[str],
    conditions: Sequence[str],
    parents: Sequence[tuple[DataFrame, str]],
) -> DataFrame:
    """Per key of `child` and its parents, side by side in one shuffle: k0…, n, n0… and has0….

    `n` counts the child's rows, `n<i>` those for which a condition holds, and `has<i>`
    tells whether a parent has the key. Each table is read once; rows are counted before
    they are shuffled, so a hot key is one row a task.
    """
    keys = [key_of(child, c).alias(f"k{i}") for i, c in enumerate(columns)]
    marks = [F.coalesce(F.expr(c), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)]
    rows = child.select(*keys, F.lit(-1).alias("side"), *marks)
    for i, (parent, column) in enumerate(parents):
        known = parent.where(col(column).isNotNull())
        rows = rows.union(
            known.select(key_of(known, column), F.lit(i), *[F.lit(False)] * len(conditions))
        )
    own = F.col("side") == -1
    return rows.groupBy(*[f"k{i}" for i in range(len(columns))]).agg(
        F.count_if(own).alias("n"),
        *[F.count_if(own & F.col(f"c{i}")).alias(f"n{i}") for i in range(len(conditions))],
        *[F.bool_or(F.col("side") == i).alias(f"has{i}") for i in range(len(parents))],
    )


def excess(n: str) -> Column:
    """Rows beyond the first of each key."""
    return F.coalesce(F.sum(F.greatest(F.col(n) - 1, F.lit(0))), F.lit(0)).cast("bigint")


def strays(n: str, has: str) -> Column:
    """Rows with a key that a parent lacks."""
    return F.coalesce(F.sum(F.when(F.col("k0").isNotNull() & ~F.col(has), F.col(n))), F.lit(0)).cast("bigint")


def first_of(places: Mapping[object, int], key: object) -> int:
    """Number of a key in order of first use; `places` is filled as keys come."""
    return places.setdefault(key, len(places))
