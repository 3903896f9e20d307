"""Report datasets.

Inputs are the small frames of a run: one row per table (`table_states`,
`reviews`, `table_rows`), per rule (`judged`), per statement (`check_log`), or
the event log.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.numbers import one_decimal, score_pct, thousands
from tablegauge.functions.text import log_second, table_cell
from tablegauge.operators.gates import gate_changes
from tablegauge.operators.rules import check_sql
from tablegauge.operators.verdict import (
    category_scores,
    mean_score,
    overall_scores,
    table_scores,
)
from tablegauge.schemas import REPORT_CATEGORIES

# Score bands of the matrix and of the cards, and list lengths.
MATRIX_BANDS = (95.0, 75.0)
CARD_BANDS = (90.0, 70.0)
CARD_SUGGESTIONS = 4
SUMMARY_SUGGESTIONS = 8
ERROR_WIDTH = 80


def score_band(score: Column, bands: tuple[float, float] = MATRIX_BANDS) -> Column:
    good, fair = bands
    return F.when(score >= good, "ok").when(score >= fair, "warn").otherwise("bad")


def table_rows(column_profile: DataFrame) -> DataFrame:
    """Row count per table, from the first column of its profile."""
    return column_profile.where(F.col("ordinal") == 1).select("table_name", "row_count")


def kpis(
    table_states: DataFrame,
    rows: DataFrame,
    check_log: DataFrame,
    judged: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """The headline numbers of a run, in one row."""
    tables = table_states.agg(F.count_distinct("table_name"))
    total = rows.agg(F.coalesce(F.sum("row_count"), F.lit(0)))
    items = check_log.where(F.col("purpose") != "dq_check").agg(F.count(F.lit(1)))
    hooks = events.where(F.col("kind") == "hook").agg(F.count(F.lit(1)))
    retried = events.where((F.col("kind") == "hook") & (F.col("outcome") == "retried")).agg(
        F.count(F.lit(1))
    )
    return overall_scores(judged).select(
        tables.scalar().alias("tables"),
        total.scalar().cast("bigint").alias("total_rows"),
        items.scalar().alias("profile_items"),
        F.col("n_rules").alias("rules"),
        F.col("dq_pass").alias("passed"),
        F.col("dq_fail").alias("failed"),
        F.col("score_report").alias("overall_score"),
        hooks.scalar().alias("hook_events"),
        retried.scalar().alias("retried"),
    )


def category_averages(judged: DataFrame) -> DataFrame:
    """Mean table score per category: NULL as printed in text, 0.0 on the page."""
    spark = judged.sparkSession
    listed = spark.createDataFrame(list(enumerate(REPORT_CATEGORIES, 1)), "pos INT, category STRING")
    means = category_scores(judged).groupBy("category").agg(
        one_decimal(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("tables")
    )
    return listed.join(means, "category", "left").select(
        "pos",
        "category",
        F.coalesce("tables", F.lit(0)).alias("tables"),
        "mean_score",
        F.coalesce("mean_score", F.lit(0.0)).alias("page_score"),
    )


def scorecard(table_states: DataFrame, rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Score matrix, tables first, and one row for the whole schema."""
    cells = category_scores(judged)
    matrix = (
        cells.groupBy("table_name")
        .pivot("category", list(REPORT_CATEGORIES))
        .agg(F.max("score"))
    )
    scores = table_scores(table_states, judged)
    per_table = (
        table_states.select("table_name", "stage")
        .join(rows, "table_name", "left")
        .join(scores, "table_name", "left")
        .join(matrix, "table_name", "left")
    )
    tables = per_table.select(
        F.lit(0).alias("part"),
        "table_name",
        "stage",
        "row_count",
        "n_rules",
        "dq_pass",
        "dq_fail",
        *REPORT_CATEGORIES,
        F.col("score_report").alias("score"),
    )
    whole = per_table.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.sum("n_rules").alias("n_rules"),
        F.sum("dq_pass").alias("dq_pass"),
        F.sum("dq_fail").alias("dq_fail"),
        *(mean_score(F.col(c)).alias(c) for c in REPORT_CATEGORIES),
    ).select(
        F.lit(1).alias("part"),
        F.lit("SCHEMA AGGREGATE").alias("table_name"),
        F.concat(F.col("n").cast("string"), F.lit(" Tables")).alias("stage"),
        "row_count",
        "n_rules",
        "dq_pass",
        "dq_fail",
        *REPORT_CATEGORIES,
        score_pct(F.col("dq_pass"), F.col("n_rules"), 0.0).alias("score"),
    )
    return tables.unionByName(whole)


def score_bands(scores: DataFrame) -> DataFrame:
    """Bands of each table's score in the matrix and on its card."""
    score = F.col("score_report")
    return scores.select(
        "table_name",
        score.alias("score"),
        score_band(score).alias("matrix_band"),
        score_band(score, CARD_BANDS).alias("card_band"),
    )


def health_cards(
    table_states: DataFrame,
    rows: DataFrame,
    judged: DataFrame,
    table_reviews: DataFrame,
) -> DataFrame:
    """One card per table with its badge and first suggestions."""
    scores = table_scores(table_states, judged)
    joined = (
        table_states.select("table_name", "stage")
        .join(rows, "table_name", "left")
        .join(scores, "table_name", "left")
        .join(table_reviews.select("table_name", "suggestions"), "table_name", "left")
    )
    badge = (
        F.when(
            F.col("dq_fail") > 0,
            F.concat(F.col("dq_fail").cast("string"), F.lit(" Violations")),
        )
        .when(F.col("stage") == "reviewed", "100% Healthy")
        .otherwise(F.col("stage"))
    )
    return joined.select(
        "table_name",
        badge.alias("badge"),
        F.coalesce(thousands(F.col("row_count")), F.lit("?")).alias("rows"),
        "n_rules",
        "dq_pass",
        "dq_fail",
        F.col("score_report").alias("score"),
        score_band(F.col("score_report"), CARD_BANDS).alias("band"),
        F.slice(
            F.coalesce("suggestions", F.array().cast("array<string>")), 1, CARD_SUGGESTIONS
        ).alias("suggestions"),
    )


def _status() -> Column:
    return (
        F.when(F.col("passed"), "PASS").when(~F.col("passed"), "FAIL").otherwise("UNCHECKED")
    )


def rule_log(judged: DataFrame) -> DataFrame:
    """Every rule with its verdict; `*` stands for the whole table."""
    return judged.select(
        "table_name",
        "rule_seq",
        "rule_id",
        "category",
        F.coalesce("column_name", F.lit("*")).alias("column_name"),
        table_cell(F.col("description")).alias("description"),
        "threshold_pct",
        "violations",
        _status().alias("status"),
        check_sql().alias("check_sql"),
    )


def search_rules(
    log: DataFrame,
    query: str = "",
    category: str = "all",
    status: str = "all",
    table: str = "all",
) -> DataFrame:
    """Rules whose text contains the query, with the given facets."""
    text = F.lower(
        F.concat_ws(" ", "table_name", "column_name", "rule_id", "category", "description")
    )
    found = log.where(text.contains(query.lower())) if query else log
    if category != "all":
        found = found.where(F.lower("category") == category)
    if status != "all":
        found = found.where(F.lower("status") == status.lower())
    if table != "all":
        found = found.where(F.col("table_name") == table)
    return found


def check_repairs(check_log: DataFrame) -> DataFrame:
    """Statements that were rewritten or that failed."""
    rewritten = F.size("fix_history") > 0
    return check_log.where(F.coalesce(rewritten, F.lit(False)) | (F.col("status") == "failed")).select(
        "table_name",
        "sql_id",
        F.coalesce("error_class", F.lit("unknown")).alias("error_class"),
        F.coalesce("attempts", F.lit(1)).alias("attempts"),
        F.when(F.col("status") == "executed", "REPAIRED").otherwise("FAILED").alias("status"),
        table_cell(
            F.when(rewritten, F.try_element_at("fix_history", F.lit(1))).otherwise(
                F.col("sql_text")
            )
        ).alias("original_sql"),
        table_cell(F.col("sql_text")).alias("final_sql"),
        F.substring(table_cell(F.coalesce("last_error", F.lit(""))), 1, ERROR_WIDTH).alias(
            "last_error"
        ),
    )


def recommendations(table_reviews: DataFrame) -> DataFrame:
    """All suggestions, numbered within their table."""
    return table_reviews.select(
        "table_name", F.posexplode("suggestions").alias("pos", "suggestion")
    ).select("table_name", (F.col("pos") + 1).alias("pos"), "suggestion")


def gate_timeline(
    decisions: DataFrame,
    *,
    compare: tuple[str, ...] = ("state", "reason"),
    order: tuple[str, ...] = ("ts",),
) -> DataFrame:
    """Gate changes in log order; `order` settles decisions of the same time."""
    changed = gate_changes(decisions, compare=compare, order=order)
    return changed.select(
        "ts",
        log_second(F.col("ts")).alias("at"),
        "gate_id",
        F.upper("state").alias("state"),
        *[F.col(c) for c in compare if c not in ("state",)],
    ).orderBy("ts", "gate_id")


def governance_summary(
    table_states: DataFrame, judged: DataFrame
) -> DataFrame:
    """Totals over the schema, with the score of checked rules."""
    stages = table_states.agg(
        F.count(F.lit(1)).alias("t"),
        F.count_if(F.col("stage") == "reviewed").alias("r"),
        F.count_if(F.col("stage") == "blocked").alias("b"),
    )
    return overall_scores(judged).select(
        stages.select("t").scalar().alias("tables"),
        stages.select("r").scalar().alias("reviewed"),
        stages.select("b").scalar().alias("blocked"),
        "dq_pass",
        "dq_fail",
        F.col("score_governance").alias("overall_score"),
        (F.col("dq_fail") == 0).alias("zero_defects"),
    )


def priority_actions(table_reviews: DataFrame, first: int = SUMMARY_SUGGESTIONS) -> DataFrame:
    """The first suggestions of the schema, in table order."""
    return recommendations(table_reviews).orderBy("table_name", "pos").limit(first)


def run_summary(
    table_states: DataFrame, table_reviews: DataFrame, gates: DataFrame
) -> DataFrame:
    """One line per table: stage, passed rules and gate states."""
    held = gates.where(F.col("table_name").isNotNull()).groupBy("table_name").agg(
        F.sort_array(F.collect_set(F.concat_ws("=", "gate_id", "state"))).alias("g")
    )
    joined = table_states.select("table_name", "stage").join(
        table_reviews.select("table_name", "dq_pass", "dq_fail"), "table_name", "left"
    ).join(held, "table_name", "left")
    checked = F.col("dq_pass") + F.col("dq_fail")
    dq = F.when(
        F.col("dq_pass").isNotNull(),
        F.concat(
            F.lit("DQ "), F.col("dq_pass").cast("string"), F.lit("/"), checked.cast("string"),
            F.lit(" pass"),
        ),
    ).otherwise("DQ pending")
    return joined.select(
        "table_name",
        "stage",
        dq.alias("dq"),
        F.coalesce(F.array_join("g", ", "), F.lit("")).alias("gates"),
    )

