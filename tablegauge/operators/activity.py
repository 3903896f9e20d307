"""Event-log analytics."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_outcomes(events: DataFrame) -> DataFrame:
    """Number of events per kind and outcome."""
    return events.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def agent_activity(events: DataFrame) -> DataFrame:
    """Calls per agent with their share of the busiest agent's, whole percent."""
    calls = events.groupBy(F.coalesce("agent", F.lit("?")).alias("agent")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    # One row per agent is left for the window.
    top = F.max("calls").over(W.partitionBy())
    bar = F.least(F.floor(F.col("calls") / top * 100).cast("int"), F.lit(100))
    return calls.select("agent", "calls", bar.alias("bar_pct")).orderBy(
        F.desc("calls"), F.asc("agent")
    )


def call_latency(events: DataFrame, by: tuple[str, ...] = ("agent",)) -> DataFrame:
    """Durations noted after calls: count, mean, maximum and exact 95th percentile.

    Durations are whole milliseconds, so the windows hold one row per distinct
    duration of a group, however many calls there are.
    """
    found = F.regexp_extract("detail", r"duration_ms=(\d+)", 1)
    timed = events.select(*by, F.nullif(found, F.lit("")).try_cast("bigint").alias("ms"))
    counted = timed.where(F.col("ms").isNotNull()).groupBy(*by, "ms").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*by).orderBy("ms")
    placed = counted.withColumns(
        {"seen": F.sum("n").over(upto), "total": F.sum("n").over(W.partitionBy(*by))}
    )
    reached = F.col("seen") >= F.ceil(F.col("total") * F.lit(0.95))
    return placed.groupBy(*by).agg(
        F.sum("n").alias("calls"),
        (F.sum(F.col("ms") * F.col("n")) / F.sum("n")).alias("avg_ms"),
        F.max("ms").alias("max_ms"),
        F.min(F.when(reached, F.col("ms"))).alias("p95_ms"),
    )
