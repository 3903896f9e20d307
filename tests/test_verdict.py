from tablegauge.operators import verdict as V
from tablegauge.schemas import RULE_RESULTS

SHORT = "table_name STRING, rule_id STRING, category STRING, threshold_pct DOUBLE, violations BIGINT, row_count BIGINT, status STRING"


def results(spark, rows):
    df = spark.createDataFrame(rows, SHORT)
    types = {f.name: f.dataType.simpleString() for f in RULE_RESULTS.fields}
    for name, dtype in types.items():
        if name not in df.columns:
            value = {"rule_seq": "1", "description": "rule_id"}.get(name, "NULL")
            df = df.selectExpr("*", f"CAST({value} AS {dtype}) AS {name}")
    return df.select(*types)


def test_thresholds(spark):
    rows = [
        ("t", "at", "validity", 99.0, 1, 100, "executed"),
        ("t", "over", "validity", 99.0, 2, 100, "executed"),
        ("t", "strict", "validity", 100.0, 1, 100, "executed"),
        ("t", "none", "completeness", 100.0, 0, 0, "executed"),
        ("t", "failed", "accuracy", 100.0, None, 100, "failed"),
        ("t", "ready", "accuracy", 100.0, None, 100, "validated"),
    ]
    judged = V.judge(results(spark, rows))
    assert {r.rule_id: r.passed for r in judged.collect()} == {
        "at": True, "over": False, "strict": False, "none": True, "failed": None, "ready": None,
    }
    counts = V.verdict_counts(judged).first()
    assert (counts.n_rules, counts.dq_pass, counts.dq_fail, counts.unchecked) == (6, 2, 2, 2)
    scores = {r.category: r.score for r in V.category_scores(judged).collect()}
    assert scores == {"validity": 33.3, "completeness": 100.0}
    whole = V.overall_scores(judged).first()
    assert (whole.score_governance, whole.score_report) == (50.0, 33.3)


def test_no_rules_have_four_defaults(spark):
    judged = V.judge(results(spark, []))
    tables = spark.createDataFrame([("bare",)], "table_name STRING")
    row = V.table_scores(tables, judged).first()
    assert (row.n_rules, row.score_log, row.score_report) == (0, 100.0, 0.0)
    whole = V.overall_scores(judged).first()
    assert (whole.score_governance, whole.score_report) == (100.0, 0.0)


def test_null_heavy_is_strictly_above_a_tenth(spark):
    profile = spark.createDataFrame(
        [("t", 1, "tenth", 100, 10), ("t", 2, "more", 100, 11), ("t", 3, "empty", 0, 0)],
        "table_name STRING, ordinal INT, column_name STRING, row_count BIGINT, null_count BIGINT",
    )
    found = V.suggestions(V.judge(results(spark, [])), profile).collect()
    assert [r.suggestion for r in found] == [
        "t.more: 11% NULLs - evaluate NOT NULL + default, or drop the column."
    ]


def test_review_lists_and_waivers(spark):
    rows = [("t", "b", "validity", 100.0, 1, 3, "executed"), ("t", "a", "validity", 100.0, 2, 0, "executed")]
    judged = V.judge(results(spark, rows))
    profile = spark.createDataFrame(
        [], "table_name STRING, ordinal INT, column_name STRING, row_count BIGINT, null_count BIGINT"
    )
    waivers = spark.createDataFrame([("t", "q2"), ("t", "q1"), ("t", "q1")], "table_name STRING, sql_id STRING")
    tables = spark.createDataFrame([("t",), ("u",)], "table_name STRING")
    found = {r.table_name: r for r in V.reviews(tables, judged, profile, waivers).collect()}
    assert found["t"].waived_items == ["q1", "q2"] and found["t"].dq_fail == 2
    assert "(0.0% of rows)" in found["t"].suggestions[0] and "(33.3% of rows)" in found["t"].suggestions[1]
    assert found["t"].category_scores == {"validity": 0.0}
    assert (found["u"].dq_pass, found["u"].suggestions, found["u"].category_scores) == (0, [], {})
