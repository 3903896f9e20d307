import pytest
from pyspark.sql import functions as F

from tablegauge import assess
from tablegauge.operators import report as R
from tablegauge.operators.activity import agent_activity, call_latency, event_outcomes


@pytest.fixture(scope="module")
def shop(spark, sample):
    return assess(spark, sample)


def test_scorecard(spark, shop):
    rows = R.table_rows(shop.column_profile)
    found = {r.table_name: r for r in R.scorecard(shop.table_states, rows, shop.judged).collect()}
    assert (found["products"].uniqueness, found["products"].score) == (50.0, 85.7)
    assert found["orders"].timeliness is None
    whole = found["SCHEMA AGGREGATE"]
    assert (whole.stage, whole.row_count, whole.n_rules, whole.score) == ("3 Tables", 23, 26, 88.5)
    assert (whole.uniqueness, whole.validity, whole.accuracy) == (83.3, 33.3, None)


def test_cards_and_bands(spark, shop):
    rows = R.table_rows(shop.column_profile)
    cards = {r.table_name: r for r in R.health_cards(shop.table_states, rows, shop.judged, shop.reviews).collect()}
    assert (cards["orders"].badge, cards["orders"].band, cards["orders"].rows) == ("1 Violations", "ok", "10")
    assert cards["products"].band == "warn"
    df = spark.createDataFrame([(s,) for s in (95.0, 94.9, 75.0, 74.9)], "s DOUBLE")
    assert [r[0] for r in df.select(R.score_band(F.col("s"))).collect()] == ["ok", "warn", "warn", "bad"]


def test_search(shop):
    log = R.rule_log(shop.judged)
    assert R.search_rules(log).count() == 26
    assert [r.rule_id for r in R.search_rules(log, "SKU", status="fail").collect()] == ["products.uniqueness.sku"]
    assert R.search_rules(log, category="uniqueness", table="customers").count() == 3
    assert R.search_rules(log, "*").count() == 3


def test_lists(shop):
    found = R.recommendations(shop.reviews).orderBy("table_name", "pos").collect()
    assert [(r.table_name, r.pos) for r in found] == [
        ("customers", 1), ("customers", 2), ("orders", 1), ("products", 1), ("products", 2),
    ]
    assert [r.table_name for r in R.priority_actions(shop.reviews, first=3).collect()] == ["customers", "customers", "orders"]
    total = R.governance_summary(shop.table_states, shop.judged).first()
    assert (total.tables, total.reviewed, total.blocked, total.zero_defects) == (3, 3, 0, False)


def test_repairs(spark):
    rows = [
        ("t", "kept", "SELECT 1", "executed", 0, None, None, []),
        ("t", "fixed", 'SELECT "a|b"\nFROM t', "executed", 1, "near a", "syntax", ["SELECT a|b", "x"]),
        ("t", "lost", "SELECT 2", "failed", 3, "e" * 100, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "table_name STRING, sql_id STRING, sql_text STRING, status STRING, attempts INT, "
        "last_error STRING, error_class STRING, fix_history ARRAY<STRING>",
    )
    found = {r.sql_id: r for r in R.check_repairs(df).collect()}
    assert set(found) == {"fixed", "lost"}
    assert (found["fixed"].status, found["fixed"].original_sql) == ("REPAIRED", "SELECT a\\|b")
    assert found["fixed"].final_sql == 'SELECT "a\\|b" FROM t'
    assert (found["lost"].status, found["lost"].error_class, found["lost"].original_sql) == ("FAILED", "unknown", "SELECT 2")
    assert len(found["lost"].last_error) == 80


def test_activity(spark):
    rows = [("hook", "ok", "a", "duration_ms=10")] * 3 + [("hook", "error", "b", "[syntax] x"), ("hook", "ok", None, "duration_ms=7")]
    df = spark.createDataFrame(rows, "kind STRING, outcome STRING, agent STRING, detail STRING")
    assert [tuple(r) for r in agent_activity(df).collect()] == [("a", 3, 100), ("?", 1, 33), ("b", 1, 33)]
    assert {(r.outcome, r.n) for r in event_outcomes(df).collect()} == {("ok", 4), ("error", 1)}
    found = {r.agent: (r.calls, r.avg_ms, r.max_ms, r.p95_ms) for r in call_latency(df).collect()}
    assert found == {"a": (3, 10.0, 10, 10), None: (1, 7.0, 7, 7)}


def test_timeline(spark):
    rows = [("2024-01-01 10:00:00.9", "G1", "open", "x"), ("2024-01-01 10:00:01", "G1", "open", "x"), ("2024-01-01 10:00:02", "G1", "closed", "x")]
    df = spark.createDataFrame(rows, "ts STRING, gate_id STRING, state STRING, reason STRING")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    found = [(r["at"], r["state"]) for r in R.gate_timeline(df).collect()]
    assert found == [("2024-01-01 10:00:00", "OPEN"), ("2024-01-01 10:00:02", "CLOSED")]
