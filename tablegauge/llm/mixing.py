"""Mixing sources to target weights as a curriculum over training time.

Each source has a weight and a schedule, a piecewise linear density over training time
from 0 to 1. Its target is its share of the demanded words, at most `repeats` times its
own. Its documents stand in a fixed pseudo-random order, once per pass; a document that
begins after c words of its source is due at the time at which the integral of the
schedule, scaled to the target, reaches c. Sorting by that time gives the training order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.words import SPACE, stored

#: Weights in turn, over sources by code point with NULL last.
WEIGHTS = (5, 2, 1)
#: Density of each weight's schedule at time 0 and 1, changing linearly: heavy sources early.
SCHEDULES = ((1.25, 0.75), (1.0, 1.0), (0.5, 1.5))
DEMAND = 1.5
REPEATS = 2
#: Documents of one source that are summed up in one piece of a window.
PIECE = 2000


def word_count(text: str) -> Column:
    return F.expr(f"coalesce(regexp_count({text}, '[^{SPACE}]+'), 0)").cast("long")


def targets(sizes: DataFrame, demand: float = DEMAND, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (source, source_size): weight, rank and target.

    A source's cap is `repeats` times its size. Sources are filled in order of cap per
    weight; the first one that stays below its cap fixes the level of all later ones. The
    windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy("per_weight", "rank")
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.lit(float(demand)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(after),
        )
        .withColumn("open", F.col("per_weight") >= F.col("level"))
    )
    level = F.min(F.when(F.col("open"), F.struct("per_weight", "rank", "level"))).over(everything)
    return ranked.withColumn("found", level).select(
        "source",
        "source_size",
        "rank",
        "weight",
        F.coalesce(F.least("cap", F.col("weight") * F.col("found.level")), F.col("cap")).alias("target"),
    )


def due(done: Column, target: Column, start: Column, end: Column) -> Column:
    """Time in [0, 1] at which a source with a linear density has given `done` of `target` words."""
    part = F.least(F.greatest(F.try_divide(done, target), F.lit(0.0)), F.lit(1.0))
    curved = (F.sqrt(start * start + (end * end - start * start) * part) - start) / (end - start)
    return F.when(F.abs(end - start) < 1e-12, part).otherwise(curved)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple[str, ...] = (),
    demand: float = DEMAND,
    repeats: int = REPEATS,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[tuple[float, float], ...] = SCHEDULES,
) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, taken, passes, `carry`.

    `passes` has a (pass, words, time) for each pass that takes words of the document;
    the pass in which its source reaches the target is cut there, so that each source
    gives its target's whole words. NULL sources are one source, the last; NULL and empty texts
    have size 0 and are never due. Rows that repeat an id are separate. The order within a
    source is that of the SHA-256 of the id, so reruns agree.
    """
    label = F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256)
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(source).alias("source"), *carry, word_count(text).alias("size"), label.alias("__order")
    )
    narrow = stored(rows, "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    sized = stored(sizes, "sources")
    planned = targets(sized.select("source", "source_size"), demand, repeats, weights)
    pick = (F.col("rank") % len(weights) + 1).cast("int")
    plan = stored(
        planned.withColumn("__none", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(
            sized.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("__none"), "__rows"),
            ["source", "__none"],
        )
        .select(
            "source", "__none", "source_size", "target",
            F.ceil(F.col("__rows") / PIECE).alias("__pieces"),
            F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedules]), pick).alias("__start"),
            F.element_at(F.array(*[F.lit(float(b)) for _, b in schedules]), pick).alias("__end"),
        ),
        "plan",
    )

    # Words before a document: those of earlier pieces of its source, and those within its piece.
    keyed = narrow.withColumn("__none", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    share = F.expr("cast(conv(substr(__order, 1, 8), 16, 10) as double) / 4294967296")
    placed = keyed.join(plan, ["source", "__none"]).withColumn("__piece", F.floor(share * F.col("__pieces")))
    pieces = placed.groupBy("source", "__none", "__piece").agg(F.sum("size").alias("__words"))
    earlier = Window.partitionBy("source", "__none").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        pieces.select("source", "__none", "__piece", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__offset")),
        "offsets",
    )
    inside = (
        Window.partitionBy("source", "__none", "__piece").orderBy("__order", "__id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = placed.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    counted = before.join(offsets, ["source", "__none", "__piece"]).withColumn("__begin", F.col("__before") + F.col("__offset"))

    goal = F.floor("target").cast("long")
    passes = []
    for k in range(repeats):
        begin = F.col("__begin") + F.col("source_size") * F.lit(k)
        words = F.least(F.greatest(goal - begin, F.lit(0)), F.col("size"))
        passes.append(
            F.struct(
                F.lit(k).alias("pass"),
                words.cast("long").alias("words"),
                due(begin.cast("double"), F.col("target"), F.col("__start"), F.col("__end")).alias("time"),
            )
        )
    taken = F.filter(F.array(*passes), lambda p: p.words > 0)
    return counted.withColumn("passes", taken).select(
        F.col("__id").alias(id_col),
        F.when(~F.col("__none"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p.words).alias("taken"),
        "passes",
        *carry,
    )


def training_order(mix: DataFrame) -> DataFrame:
    """One row per document and pass of a mix, range-sorted by the time it is due."""
    due_rows = mix.select("*", F.explode("passes").alias("__pass")).select(
        *[c for c in mix.columns if c != "passes"],
        F.col("__pass.pass").alias("pass"),
        F.col("__pass.words").alias("words"),
        F.col("__pass.time").alias("time"),
    )
    return due_rows.orderBy("time", *mix.columns[:1], "pass")


def by_first_due(mix: DataFrame) -> DataFrame:
    """The rows of a mix range-sorted by the time their first pass is due, those never due last."""
    return mix.orderBy(F.try_element_at("passes", F.lit(1))["time"].asc_nulls_last(), mix.columns[0])
