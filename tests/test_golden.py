from pyspark.sql import functions as F

from tablegauge import assess
from tablegauge.operators.report import category_averages, kpis, table_rows
from tablegauge.operators.verdict import overall_scores, table_scores

ADVICE = [
    "customers.email [validity] FAILED: email must look like an email - 1 violation(s) "
    "(12.5% of rows). Consider a constraint, backfill or upstream fix.",
    "customers.email: 25% NULLs - evaluate NOT NULL + default, or drop the column.",
    "orders.amount [validity] FAILED: amount must be >= 0 - 1 violation(s) (10.0% of rows). "
    "Consider a constraint, backfill or upstream fix.",
    "products.sku [uniqueness] FAILED: sku must be unique - 1 violation(s) (20.0% of rows). "
    "Consider a constraint, backfill or upstream fix.",
    "products.sku: 20% NULLs - evaluate NOT NULL + default, or drop the column.",
]


def test_sample_assessment(spark, sample):
    found = assess(spark, sample)
    rules = [r.rule_id for r in found.judged.orderBy("table_name", "rule_seq").collect()]
    assert len(rules) == 26
    assert rules[:9] == [
        "customers.consistency.non_empty",
        "customers.completeness.id",
        "customers.uniqueness.id",
        "customers.completeness.name",
        "customers.uniqueness.name",
        "customers.validity.email",
        "customers.completeness.group",
        "customers.completeness.created_at",
        "customers.uniqueness.created_at",
    ]
    failed = found.judged.where(~F.col("passed")).orderBy("table_name").collect()
    assert [(r.rule_id, r.violations) for r in failed] == [
        ("customers.validity.email", 1),
        ("orders.validity.amount", 1),
        ("products.uniqueness.sku", 1),
    ]
    whole = overall_scores(found.judged).first()
    assert (whole.dq_pass, whole.dq_fail, whole.score_report) == (23, 3, 88.5)
    scores = {r.table_name: r.score_report for r in table_scores(found.table_states, found.judged).collect()}
    assert scores == {"customers": 88.9, "orders": 90.0, "products": 85.7}
    means = {r.category: r.mean_score for r in category_averages(found.judged).collect()}
    assert means == {
        "completeness": 100.0,
        "uniqueness": 83.3,
        "validity": 33.3,
        "consistency": 100.0,
        "timeliness": None,
        "accuracy": None,
    }
    advice = [s for r in found.reviews.orderBy("table_name").collect() for s in r.suggestions]
    assert advice == ADVICE
    assert found.check_log.where("purpose <> 'dq_check'").count() == 37
    assert {r.stage for r in found.table_states.collect()} == {"reviewed"}
    events = spark.createDataFrame(
        [("hook", "ok"), ("hook", "retried"), ("gate", None)], "kind STRING, outcome STRING"
    )
    head = kpis(
        found.table_states, table_rows(found.column_profile), found.check_log, found.judged, events
    ).first()
    assert head.asDict() == {
        "tables": 3,
        "total_rows": 23,
        "profile_items": 37,
        "rules": 26,
        "passed": 23,
        "failed": 3,
        "overall_score": 88.5,
        "hook_events": 2,
        "retried": 1,
    }
