"""User catalogues of metrics and rules, read from JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.schemas import METRIC_LINE, RULE_LINE, RULES


def read_metric_catalogue(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Metrics `{table_name, sql_id, purpose, column, expr | sql_text | sql}`."""
    found = spark.read.schema(METRIC_LINE).option("multiLine", not lines).json(path)
    return metric_specs(found)


def metric_specs(found: DataFrame) -> DataFrame:
    return found.select(
        "table_name",
        "sql_id",
        "purpose",
        F.col("column").alias("column_name"),
        "expr",
        F.coalesce(F.nullif("sql_text", F.lit("")), "sql").alias("sql_text"),
    )


def read_rule_catalogue(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Rules of a catalogue.

    A rule gives either `check_kind` with `params`, or `check_sql`: a statement
    returning the violation count, as text or as an object with `sql_text` or
    `sql`. The threshold defaults to 100 and the description to empty.
    """
    found = spark.read.schema(RULE_LINE).option("multiLine", not lines).json(path)
    return rule_specs(found)


def rule_specs(found: DataFrame) -> DataFrame:
    nested = F.when(
        F.col("check_sql").startswith("{"),
        F.from_json("check_sql", "sql_text STRING, sql STRING"),
    )
    text = F.when(
        nested.isNotNull(),
        F.coalesce(F.nullif(nested["sql_text"], F.lit("")), nested["sql"], F.lit("")),
    ).otherwise(F.coalesce("check_sql", F.lit("")))
    described = found.select(
        "table_name",
        F.lit(0).alias("rule_seq"),
        "rule_id",
        F.col("column").alias("column_name"),
        "category",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("check_kind", F.lit("sql")).alias("check_kind"),
        F.when(F.col("check_kind").isNull(), F.create_map(F.lit("sql_text"), text))
        .otherwise(F.coalesce("params", F.create_map().cast("map<string,string>")))
        .alias("params"),
        F.coalesce("threshold_pct", F.lit(100.0)).alias("threshold_pct"),
    )
    return described.select(*RULES.fieldNames())
