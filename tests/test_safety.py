"""Results that must not depend on modes, views, layouts or collations."""

import pytest
from pyspark.sql import functions as F

from tablegauge import assess
from tablegauge.plans.assess import resume
from tablegauge.sources.runs import fork_run
from tablegauge.operators import gates as G
from tablegauge.operators import profile as P
from tablegauge.operators.checks import duplicate_excess, rule, rules_frame, run_rules
from tablegauge.operators.metrics import custom_metrics, summarise_metrics
from tablegauge.operators.rules import statement_id
from tablegauge.streaming import live


def metric(table, sql_id, purpose, column=None, *, expr=None, sql=None):
    return {"table_name": table, "sql_id": sql_id, "purpose": purpose, "column_name": column, "expr": expr, "sql_text": sql}


def test_long_text_of_another_collation_groups_by_its_own_equality(spark):
    df = spark.sql(
        "SELECT v COLLATE UTF8_LCASE AS v FROM VALUES (repeat('Ab', 40)), (repeat('aB', 40)), ('ab'), ('AB') AS t(v)"
    )
    assert P.profile_table(df, "t").first().distinct_count == 2
    assert duplicate_excess(df, ["v"]).first().violations == 2
    assert [r.n for r in P.top_values(df, ["v"]).collect()] == [2, 2]


def test_approximate_profiles_give_exact_verdicts(spark):
    rows = spark.range(20_011)
    table = rows.select(
        F.col("id"),
        (F.col("id") * 7).alias("key_like"),
        F.when(F.col("id") % 400 == 0, 0).otherwise(F.col("id")).alias("near_key"),
        F.when(F.col("id") != 5, F.col("id")).alias("code"),
        (F.col("id") % 9).alias("few"),
    )
    exact, approx = (assess(spark, {"t": table}, mode=m).judged.collect() for m in ("exact", "approx"))
    fields = ("rule_id", "violations", "passed")
    assert sorted(tuple(r[f] for f in fields) for r in exact) == sorted(tuple(r[f] for f in fields) for r in approx)
    assert {r.rule_id: r.violations for r in approx}["t.uniqueness.id"] == 0


def test_views_of_the_session_survive(spark):
    spark.range(3).createOrReplaceTempView("orders")
    tables = {"orders": spark.range(10), "other": spark.range(4)}
    found = custom_metrics(tables, [metric("orders", "m", "row_count", sql="SELECT count(*) FROM orders")])
    assert found.first().cells == ["10"]
    counted = run_rules(spark, tables, rules_frame(spark, [rule("orders", "r", "sql", sql_text="SELECT count(*) FROM other")]))
    assert counted.first().violations == 4
    assert spark.table("orders").count() == 3
    assert not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("orders")


def test_a_metric_that_fails_while_running_leaves_the_others(spark):
    tables = {"t": spark.createDataFrame([("1",), ("x",)], "v STRING"), "u": spark.range(5)}
    specs = [
        metric("t", "a", "row_count", expr="count(*)"),
        metric("t", "b", "distinct", "v", expr="count(DISTINCT CAST(v AS INT))"),
        metric("t", "c", "min", "v", sql="SELECT min(CAST(v AS INT)) FROM t"),
        metric("u", "d", "row_count", expr="count(*)"),
    ]
    found = custom_metrics(tables, specs)
    assert {r.sql_id: (r.status, r.error_class) for r in found.collect()} == {
        "a": ("executed", None), "b": ("failed", "type_mismatch"), "c": ("failed", "type_mismatch"), "d": ("executed", None),
    }
    summary = {r.table_name: (r.column_name, r.row_count) for r in summarise_metrics(found).collect()}
    assert summary == {"t": (None, 2), "u": (None, 5)}


def test_decisions_without_a_gate_are_one_gate(spark):
    rows = [(i, None if i % 2 else "G1", "open", "r") for i in range(40)]
    df = spark.createDataFrame(rows, "ts INT, gate_id STRING, state STRING, reason STRING")
    assert G.gate_changes(df, slices=4).count() == 2


def test_review_gate_names_rules(spark):
    log = spark.createDataFrame([("t", "t.validity.a", "failed")], "table_name STRING, rule_id STRING, status STRING")
    assert "(t.validity.a)" in G.gate_review(log).first().reason


def test_statement_ids_of_derived_rules(spark, sample):
    found = assess(spark, {"customers": sample["customers"]})
    ids = {r.sql_id for r in found.judged.select(statement_id().alias("sql_id")).collect()}
    assert {"dq.customers.non_empty", "dq.customers.null.id", "dq.customers.dup.id", "dq.customers.email.email"} <= ids
    texts = {r.sql_id: r.sql_text for r in found.check_log.collect()}
    assert texts["dq.customers.email.email"] == "SELECT COUNT(*) FROM `customers` WHERE `email` NOT LIKE '%_@_%._%'"


def test_type_names_of_a_catalogue(spark):
    rows = [("s", "t", i, f"c{i}", name, True, None) for i, name in enumerate(("NUMERIC", "money", "interval", "text"), 1)]
    manifest = spark.createDataFrame(rows, "schema_name STRING, table_name STRING, ordinal INT, column_name STRING, dtype STRING, nullable BOOLEAN, row_estimate LONG")
    assert P.profile_plan_size(manifest, spark_types=False).first().numeric_columns == 3
    found = P.profile_statements(manifest, spark_types=False).where("purpose = 'min_max'")
    assert found.count() == 3


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_a_file_and_a_folder(spark, tmp_path, parts):
    folder, name = str(tmp_path), "readings"
    df = spark.range(30).select("id", (F.col("id") % 4).alias("v"))
    df.repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    if parts == 1:
        written = next((tmp_path / f"{name}.parquet").glob("part-*.parquet"))
        folder = f"{folder}/single"
        (tmp_path / "single").mkdir()
        written.rename(tmp_path / "single" / f"{name}.parquet")
    stream = live.stream_table(spark, folder, name, df.schema)
    out = f"{folder}/out"
    live.write_batch_violations(
        stream, [rule(name, "v", "range", "v", high="2")], out, f"{folder}/progress", trigger={"availableNow": True}
    ).awaitTermination()
    assert live.batch_totals(spark, out).first().violations == 7


def test_a_broken_table_leaves_statements_without_a_table(spark):
    broken = spark.range(5).selectExpr("id", "CAST(concat('x', id) AS INT) AS amount")
    free = rule("x", "free", "sql", sql_text="SELECT count(*) FROM good")
    catalogue = rules_frame(spark, [free]).withColumn("table_name", F.lit(None).cast("string"))
    found = assess(spark, {"good": spark.range(3), "broken": broken}, catalogue=catalogue)
    assert found.judged.where("rule_id = 'free'").count() == 1


def test_a_resumed_run_equals_a_whole_one(spark, sample, tmp_path):
    whole = assess(spark, sample, schema_name="s")
    whole.save("first", str(tmp_path))
    stored = fork_run(spark, "first", "second", str(tmp_path), reset="orders")
    resumed = resume(spark, sample, stored, schema_name="s")
    for name, df in whole.entities().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, resumed.entities()[name].collect())), name
    assert resumed.final_gate.first() == whole.final_gate.first()
    again = resume(spark, sample, resumed.entities(), schema_name="s")
    assert again.judged.count() == whole.judged.count()
