"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Most texts are settled by their length and a hash of their beginning; only texts that
share both with another one are hashed in full. Texts are never shuffled: what moves is
a length and a hash a row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.words import squeezed_sql, stored

PREFIX = 64
SLOTS = 1 << 20
SLOT = f"pmod(xxhash64(__n, __prefix), {SLOTS})"


def _bitmap(keys: DataFrame) -> F.Column:
    """Which of `SLOTS` slots the keys hit, as a scalar subquery of `SLOTS` bits."""
    words = keys.groupBy(F.expr(f"shiftright({SLOT}, 6)").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({SLOT} & 63 as int))")).alias("bits")
    )
    every = keys.sparkSession.range(SLOTS >> 6).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("bits"))
    return listed.scalar()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, and the `carry` columns.

    Texts are equal when identical after replacing each run of white space by one space;
    NULL counts as empty. Of equal texts the smallest id stays (NULL ids last); of rows
    that repeat an id with an equal text exactly one stays. An empty table gives no rows.
    """
    size, prefix = "length(__text)", f"xxhash64(substr(__text, 1, {PREFIX}))"
    squeezed = docs.select(F.col(id_col), *carry, F.expr(squeezed_sql(text)).alias("__text"))
    keyed = squeezed.select(F.expr(size).alias("__n"), F.expr(prefix).alias("__prefix"))

    # Length, then prefix: counts of both come from one pass, so the lengths are theirs.
    prefixes = stored(keyed.groupBy("__n", "__prefix").agg(F.count("*").alias("__rows")), "prefixes")
    lengths = prefixes.groupBy("__n").agg(F.sum("__rows").alias("__of_length")).filter("__of_length > 1")
    open_keys = stored(
        prefixes.join(lengths, "__n", "left_semi").filter("__rows > 1").select("__n", "__prefix"), "survivors"
    )

    # Full hashes, where the bitmap says that length and prefix may have met.
    met = _has(_bitmap(open_keys))
    rows = squeezed.select(id_col, *carry, F.expr(size).alias("__n"), F.expr(prefix).alias("__prefix"), "__text").select(
        id_col,
        *carry,
        "__n",
        "__prefix",
        F.when(met, F.unhex(F.sha2("__text", 256))).alias("__full"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = stored(rows, "hashed")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row")))
    groups = (
        rows.filter("__full is not null")
        .groupBy("__n", "__prefix", "__full")
        .agg(first.alias("__first"), F.count("*").alias("__size"))
        .filter("__size > 1")
    )
    found = rows.join(stored(groups, "groups"), ["__n", "__prefix", "__full"], "left")
    return found.select(
        F.col(id_col),
        F.when(F.col("__first").isNull(), F.col(id_col)).otherwise(F.col("__first.id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__first.row") == F.col("__row"), F.lit(True)).alias("kept"),
        *carry,
    )


def _has(bits: F.Column) -> F.Column:
    word = F.element_at(bits, F.expr(f"cast(shiftright({SLOT}, 6) + 1 as int)"))
    return F.expr(f"shiftleft(1L, cast({SLOT} & 63 as int))").bitwiseAND(word) != 0
