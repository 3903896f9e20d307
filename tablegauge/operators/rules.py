"""Rules: derived from a column profile, and settled from one.

A derived rule asks for a number the profile already holds or implies, so its
violations need no further look at the table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.profile import (
    EMAIL_LIKE,
    EMAIL_NAME,
    KEY_NAMES,
    NON_NEGATIVE_NAMES,
    numeric_dtype,
)
from tablegauge.schemas import RULE_RESULTS, RULES

# Pass thresholds.
THRESHOLDS = {
    "non_empty": 100.0,
    "completeness": 99.0,
    "uniqueness": 100.0,
    "email": 95.0,
    "non_negative": 100.0,
}
DERIVED_KINDS = tuple(THRESHOLDS)


# Violations of a derived rule, from the profile of its column. Copies of a
# value beyond the first are the rows less the groups, NULL being one group.
_COUNTS = {
    "non_empty": "CAST(row_count = 0 AS BIGINT)",
    "completeness": "null_count",
    "uniqueness": "row_count - distinct_count - CAST(null_count > 0 AS BIGINT)",
    "email": "miss_count",
    "non_negative": "negative_count",
}
_CATEGORY = {
    "non_empty": "consistency",
    "completeness": "completeness",
    "uniqueness": "uniqueness",
    "email": "validity",
    "non_negative": "validity",
}
# Wording of derived rules.
_SAYS = {
    "non_empty": "%s must contain rows",
    "completeness": "%s should be populated (>=99%%)",
    "uniqueness": "%s must be unique",
    "email": "%s must look like an email",
    "non_negative": "%s must be >= 0",
}
# Place of a rule among those of its column; the table's own rule comes first.
_PLACE = {"non_empty": -9, "completeness": 1, "uniqueness": 2, "email": 3, "non_negative": 3}

_EMAIL = f"contains(lower(column_name), '{EMAIL_NAME}')"
_QUANTITY = " OR ".join(f"contains(lower(column_name), '{n}')" for n in NON_NEGATIVE_NAMES)
_KEY = ", ".join(f"'{n}'" for n in KEY_NAMES)
# When the profile of a column calls for a rule. The rule that a table must hold
# rows rides on its first column, so that no grouping is needed.
_CALLS_FOR = {
    "non_empty": "ordinal = 1",
    "completeness": "NOT nullable OR endswith(lower(column_name), 'id') "
    "OR coalesce(null_count, 0) = 0",
    "uniqueness": "row_count > 0 AND (coalesce(distinct_count = row_count, false) "
    f"OR lower(column_name) IN ({_KEY}))",
    "email": _EMAIL,
    "non_negative": f"NOT {_EMAIL} AND ({_QUANTITY}) AND is_number",
}


def _candidate(kind: str) -> str:
    of_table = kind == "non_empty"
    category = _CATEGORY[kind]
    fields = {
        "rule_seq": f"CAST(ordinal * 10 + {_PLACE[kind]} AS INT)",
        "rule_id": f"concat_ws('.', table_name, '{category}', "
        f"{chr(39) + kind + chr(39) if of_table else 'column_name'})",
        "column_name": "CAST(NULL AS STRING)" if of_table else "column_name",
        "category": f"'{category}'",
        "description": f"format_string('{_SAYS[kind]}', "
        f"{'table_name' if of_table else 'column_name'})",
        "check_kind": f"'{kind}'",
        "params": "CAST(map() AS MAP<STRING, STRING>)",
        "threshold_pct": f"{THRESHOLDS[kind]}D",
        "violations": _COUNTS[kind],
        "row_count": "row_count",
    }
    struct = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"CASE WHEN {_CALLS_FOR[kind]} THEN named_struct({struct}) END"


def _candidates(column_profile: DataFrame) -> DataFrame:
    """Rules that the profile calls for, with the counts it holds for them."""
    rules = ", ".join(_candidate(kind) for kind in DERIVED_KINDS)
    typed = column_profile.withColumn("is_number", numeric_dtype(F.col("dtype")))
    return typed.selectExpr(
        "table_name", f"inline(filter(array({rules}), r -> r IS NOT NULL))"
    )


# Short names of derived rules in statement ids.
_SHORT = {
    "non_empty": "non_empty",
    "completeness": "null",
    "uniqueness": "dup",
    "email": "email",
    "non_negative": "nonneg",
}


def statement_id() -> Column:
    """Id of a rule's check: `dq.<table>.<kind>.<column>` if derived, else `dq.<rule id>`."""
    derived = F.col("params").isNull() | (F.size("params") == 0)
    chain = F.when(F.lit(False), F.lit(""))
    for kind, short in _SHORT.items():
        named = F.concat_ws(".", F.lit("dq"), "table_name", F.lit(short), "column_name")
        chain = chain.when(derived & (F.col("check_kind") == kind), named)
    return chain.otherwise(F.concat(F.lit("dq."), F.col("rule_id")))


def check_sql() -> Column:
    """A query whose first cell is a rule's violation count; kinds that need more than a query give their name."""
    quoted = F.concat(F.lit("`"), F.replace("column_name", F.lit("`"), F.lit("``")), F.lit("`"))
    table = F.concat(F.lit("`"), F.replace("table_name", F.lit("`"), F.lit("``")), F.lit("`"))

    def query(test: str) -> Column:
        before, _, after = test.partition("{}")
        return F.concat(F.lit("SELECT COUNT(*) FROM "), table, F.lit(f" WHERE {before}"), quoted, F.lit(after))

    return (
        F.when(F.col("params")["sql_text"].isNotNull(), F.col("params")["sql_text"])
        .when(F.col("check_kind") == "completeness", query("{} IS NULL"))
        .when(F.col("check_kind") == "email", query(f"{{}} NOT LIKE '{EMAIL_LIKE}'"))
        .when(F.col("check_kind") == "non_negative", query("{} < 0"))
        .when(
            F.col("check_kind") == "uniqueness",
            F.concat(
                F.lit("SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM "), table,
                F.lit(" GROUP BY "), quoted, F.lit(") AS g"),
            ),
        )
        .when(
            F.col("check_kind") == "non_empty",
            F.concat(F.lit("SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM "), table),
        )
        .otherwise(F.col("check_kind"))
    )


def derive_rules(column_profile: DataFrame) -> DataFrame:
    """Rules that the profile calls for; `rule_seq` is their order in a table."""
    return _candidates(column_profile).select(*RULES.fieldNames())


def _as_results(counted: DataFrame) -> DataFrame:
    """Result rows; a rule whose count the profile lacks stays unchecked."""
    unknown = F.col("violations").isNull()
    return counted.withColumns(
        {
            "validated": F.lit(True),
            "status": F.when(unknown, "validated").otherwise("executed"),
            "passed": F.lit(None).cast("boolean"),
            "error_class": F.lit(None).cast("string"),
            "last_error": F.lit(None).cast("string"),
        }
    ).select(*RULE_RESULTS.fieldNames())


def derive_and_settle(column_profile: DataFrame) -> DataFrame:
    """Derived rules with their violations, in one pass over the profile."""
    return _as_results(_candidates(column_profile))


def settle_rules(rules: DataFrame, column_profile: DataFrame) -> DataFrame:
    """Violations of stored derived rules, from a newer profile."""
    per_column = F.array(F.col("column_name"))
    with_table = F.array(F.col("column_name"), F.lit(None).cast("string"))
    known = column_profile.select(
        F.col("table_name").alias("t"),
        F.explode(F.when(F.col("ordinal") == 1, with_table).otherwise(per_column)).alias("c"),
        "row_count",
        "null_count",
        "distinct_count",
        "miss_count",
        "negative_count",
    )
    same = (F.col("table_name") == F.col("t")) & F.col("column_name").eqNullSafe(F.col("c"))
    met = rules.join(known, same, "left")
    counts = " ".join(f"WHEN '{kind}' THEN {count}" for kind, count in _COUNTS.items())
    return _as_results(met.withColumn("violations", F.expr(f"CASE check_kind {counts} END")))
