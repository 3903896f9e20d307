"""Verdicts, scores and suggestions from rule results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.numbers import (
    one_decimal,
    one_decimal_text,
    score_pct,
    share_pct,
    whole_text,
)
from tablegauge.schemas import RULE_RESULTS

# Wording of suggestions and the share of NULLs worth one.
FAILED_ADVICE = (
    "%s.%s [%s] FAILED: %s - %d violation(s) (%s%% of rows). "
    "Consider a constraint, backfill or upstream fix."
)
NULL_ADVICE = "%s.%s: %s%% NULLs - evaluate NOT NULL + default, or drop the column."
NULL_HEAVY = 0.10


def judge(results: DataFrame) -> DataFrame:
    """Set `passed`; a rule that was not executed stays NULL, unchecked."""
    rows = F.coalesce("row_count", F.lit(0))
    allowed = rows * (F.lit(100.0) - F.col("threshold_pct")) / F.lit(100.0)
    verdict = F.when(
        F.col("status") == "executed", F.coalesce("violations", F.lit(0)) <= allowed
    )
    return results.withColumn("passed", verdict).select(*RULE_RESULTS.fieldNames())


def verdict_counts(judged: DataFrame) -> DataFrame:
    """Rules, passes, failures and unchecked rules per table."""
    return judged.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if("passed").alias("dq_pass"),
        F.count_if(~F.col("passed")).alias("dq_fail"),
        F.count_if(F.col("passed").isNull()).alias("unchecked"),
    )


def category_scores(judged: DataFrame) -> DataFrame:
    """Share of passed rules per table and category, over executed rules."""
    return (
        judged.where(F.col("passed").isNotNull())
        .groupBy("table_name", "category")
        .agg(F.count_if("passed").alias("ok"), F.count(F.lit(1)).alias("total"))
        .select(
            "table_name", "category", "ok", "total",
            score_pct(F.col("ok"), F.col("total"), 0.0).alias("score"),
        )
    )


def suggestions(judged: DataFrame, column_profile: DataFrame) -> DataFrame:
    """Advice per table: failed rules in rule order, then null-heavy columns."""
    violations = F.coalesce("violations", F.lit(0))
    pct = share_pct(violations, F.col("row_count"))
    failed = judged.where(~F.col("passed")).select(
        "table_name",
        F.lit(1).alias("part"),
        F.col("rule_seq").alias("seq"),
        F.col("rule_id").alias("item"),
        F.format_string(
            FAILED_ADVICE, F.col("table_name"), F.coalesce("column_name", F.lit("*")),
            F.col("category"), F.col("description"), violations, one_decimal_text(pct),
        ).alias("suggestion"),
    )
    share = F.col("null_count") / F.col("row_count")
    heavy = column_profile.where((F.col("row_count") > 0) & (share > NULL_HEAVY)).select(
        "table_name",
        F.lit(2).alias("part"),
        F.col("ordinal").alias("seq"),
        F.col("column_name").alias("item"),
        F.format_string(
            NULL_ADVICE, F.col("table_name"), F.col("column_name"),
            whole_text(share * F.lit(100.0)),
        ).alias("suggestion"),
    )
    return failed.unionByName(heavy)


def reviews(
    tables: DataFrame,
    judged: DataFrame,
    column_profile: DataFrame,
    waivers: DataFrame | None = None,
) -> DataFrame:
    """One review per table of `tables(table_name)`.

    The lists hold at most one entry per rule or column of the table.
    """
    names = tables.select("table_name").distinct()
    counts = verdict_counts(judged).select("table_name", "dq_pass", "dq_fail")
    scores = (
        category_scores(judged)
        .groupBy("table_name")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "score")))).alias("m"))
    )
    advice = (
        suggestions(judged, column_profile)
        .groupBy("table_name")
        .agg(F.sort_array(F.collect_list(F.struct("part", "seq", "item", "suggestion"))).alias("s"))
    )
    out = (
        names.join(counts, "table_name", "left")
        .join(scores, "table_name", "left")
        .join(advice, "table_name", "left")
    )
    if waivers is not None:
        listed = waivers.groupBy("table_name").agg(
            F.sort_array(F.collect_set("sql_id")).alias("waived_items")
        )
        out = out.join(listed, "table_name", "left")
    else:
        out = out.withColumn("waived_items", F.lit(None).cast("array<string>"))
    nothing = F.array().cast("array<string>")
    return out.select(
        "table_name",
        F.lit(True).alias("profile_ok"),
        F.coalesce("dq_pass", F.lit(0)).alias("dq_pass"),
        F.coalesce("dq_fail", F.lit(0)).alias("dq_fail"),
        F.coalesce("m", F.create_map().cast("map<string,double>")).alias("category_scores"),
        F.coalesce(F.transform("s", lambda x: x["suggestion"]), nothing).alias("suggestions"),
        F.coalesce("waived_items", nothing).alias("waived_items"),
    )


def table_scores(tables: DataFrame, judged: DataFrame) -> DataFrame:
    """Score per table as the run log prints it and as the report prints it.

    Both divide by all rules, unchecked ones too; they differ for a table
    without rules.
    """
    counted = tables.select("table_name").distinct().join(
        verdict_counts(judged), "table_name", "left"
    )
    n, ok = F.coalesce("n_rules", F.lit(0)), F.coalesce("dq_pass", F.lit(0))
    return counted.select(
        "table_name",
        n.alias("n_rules"),
        ok.alias("dq_pass"),
        F.coalesce("dq_fail", F.lit(0)).alias("dq_fail"),
        score_pct(ok, n, 100.0).alias("score_log"),
        score_pct(ok, n, 0.0).alias("score_report"),
    )


def overall_scores(judged: DataFrame) -> DataFrame:
    """Score over all tables: of checked rules (governance) and of all rules (report)."""
    total = judged.agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if("passed").alias("dq_pass"),
        F.count_if(~F.col("passed")).alias("dq_fail"),
    )
    checked = F.col("dq_pass") + F.col("dq_fail")
    return total.select(
        "n_rules", "dq_pass", "dq_fail",
        score_pct(F.col("dq_pass"), checked, 100.0).alias("score_governance"),
        score_pct(F.col("dq_pass"), F.col("n_rules"), 0.0).alias("score_report"),
    )


def without_waived(items: DataFrame, waivers: DataFrame) -> DataFrame:
    """Items that nobody waived; waivers are unique per table and statement."""
    keys = waivers.select("table_name", "sql_id").distinct()
    return items.join(keys, ["table_name", "sql_id"], "left_anti")


def mean_score(score: Column) -> Column:
    return one_decimal(F.avg(score))
