import json
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tablegauge import assess
from tablegauge.operators.metrics import custom_metrics, summarise_metrics
from tablegauge.sources import audit_log, catalogues, reports, runs, storage, tables

FIRST = "first-run_1"


def test_jdbc_options():
    assert tables.jdbc_options("jdbc:x", "s.t") == {
        "url": "jdbc:x", "dbtable": "s.t", "fetchsize": "10000",
    }
    split = tables.jdbc_options("jdbc:x", "t", partition=("id", 1, 100, 8), user="u")
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8"
    assert (split["lowerBound"], split["upperBound"], split["user"]) == ("1", "100", "u")


def test_discovery_query_of_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute('CREATE TABLE b (id INTEGER PRIMARY KEY, "group" TEXT NOT NULL, free)')
    db.execute("CREATE TABLE a (x NUMERIC)")
    db.execute("CREATE VIEW v AS SELECT 1")
    found = db.execute(tables.discovery_query("jdbc:sqlite:f", "main")).fetchall()
    assert sorted(found) == [
        ("", "a", 1, "x", "NUMERIC", 1),
        ("", "b", 1, "id", "INTEGER", 1),
        ("", "b", 2, "group", "TEXT", 0),
        ("", "b", 3, "free", "TEXT", 1),
    ]


def test_discovery_query_of_a_standard_catalogue():
    db = duckdb.connect()
    db.execute("CREATE TABLE t (id INTEGER NOT NULL, name VARCHAR)")
    db.execute("CREATE VIEW v AS SELECT * FROM t")
    found = db.execute(tables.discovery_query("jdbc:postgresql:x", "main")).fetchall()
    assert sorted(found) == [
        ("main", "t", 1, "id", "INTEGER", 0),
        ("main", "t", 2, "name", "VARCHAR", 1),
    ]


def test_file_and_catalogue_tables(spark, sample, tmp_path):
    sample["orders"].write.parquet(f"{tmp_path}/orders.parquet")
    sample["orders"].write.option("header", True).csv(f"{tmp_path}/orders.csv")
    files = tables.load_tables(spark, {"format": "parquet", "path": str(tmp_path)}, ["orders"])
    assert files["orders"].count() == 10
    options = {"header": True, "inferSchema": True}
    text = tables.load_table(spark, {"format": "csv", "path": str(tmp_path), "options": options}, "orders")
    assert text.schema["id"].dataType.simpleString() == "int" and text.count() == 10
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_test")
    spark.sql(f"CREATE TABLE shop_test.orders USING parquet LOCATION '{tmp_path}/orders.parquet'")
    listed = tables.load_tables(spark, {"format": "catalog", "schema": "shop_test"})
    assert list(listed) == ["orders"] and listed["orders"].count() == 10
    spark.sql("DROP DATABASE shop_test CASCADE")
    with pytest.raises(ValueError):
        tables.load_tables(spark, {"format": "parquet", "path": str(tmp_path)})


def test_event_log_drops_only_broken_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = [
        {"kind": "gate", "ts": "2024-01-01T10:00:00.123+00:00", "gate_id": "G1", "evidence": {"tables": 0}},
        {"kind": "gate", "ts": "not a time", "gate_id": "G2", "evidence": {"executed": ["a", "b"]}},
        {"kind": "note", "ts": "2024-01-01T10:00:01Z", "detail": "x", "run": "r", "more": [1]},
    ]
    text = "\n".join([json.dumps(lines[0]), "", "   ", '{"kind": "ga', json.dumps(lines[1]), "[broken", json.dumps(lines[2])])
    (path / "part.json").write_text(text + "\n")
    found = audit_log.read_audit(spark, str(path)).orderBy("ts").collect()
    assert [r.gate_id or r.detail for r in found] == ["G1", "x", "G2"]
    assert found[2].event_ts is None and found[0].event_ts.second == 0
    assert json.loads(found[0].evidence) == {"tables": 0}
    audit_log.append_audit(spark.createDataFrame([("hook", "ok")], "kind STRING, outcome STRING"), str(path))
    again = audit_log.read_audit(spark, str(path))
    assert again.count() == 4
    assert again.where("outcome = 'ok' AND event_ts IS NOT NULL").count() == 1


def test_run_storage(spark, sample, tmp_path):
    root = str(tmp_path)
    found = assess(spark, sample)
    found.save(FIRST, root)
    found.save(FIRST, root)
    loaded = runs.load_run(spark, FIRST, root)
    assert set(loaded) == set(runs.ENTITIES)
    for name, df in found.entities().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, loaded[name].collect()))
    forked = runs.fork_run(spark, FIRST, "second", root, reset="orders")
    states = {r.table_name: r.stage for r in forked["table_states"].collect()}
    assert states == {"customers": "reviewed", "orders": "discovery", "products": "reviewed"}
    assert forked["rule_results"].count() == 16
    assert forked["manifest"].count() == 14
    assert runs.load_run(spark, FIRST, root)["rule_results"].count() == 26
    left = tables.pending_tables(forked["manifest"], forked["table_states"])
    assert [r.table_name for r in left.collect()] == ["orders"]
    counts = tables.resume_summary(forked["manifest"], forked["table_states"]).first()
    assert (counts.pending, counts.skipped) == (1, 2)
    whole = runs.fork_run(spark, FIRST, "third", root)
    assert whole["rule_results"].count() == 26
    with pytest.raises(ValueError):
        runs.fork_run(spark, FIRST, FIRST, root)
    with pytest.raises(ValueError):
        runs.save_run("../x", {}, root) or runs.load_run(spark, "../x", root)


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    before = storage.shared_folder(spark)
    assert storage.shared_folder(spark) == before
    assert storage.run_folder(spark, "a") != storage.run_folder(spark, "a")
    assert storage.run_folder(spark, "a").startswith(before)


def test_catalogues(spark, sample, tmp_path):
    rule_file, metric_file = tmp_path / "rules.json", tmp_path / "metrics.json"
    rule_file.write_text(json.dumps([
        {"table_name": "orders", "rule_id": "a", "category": "validity", "check_sql": "SELECT 1"},
        {"table_name": "orders", "rule_id": "b", "category": "validity", "column": "id",
         "check_sql": {"sql_text": "", "sql": "SELECT 2"}, "threshold_pct": 90},
        {"table_name": "orders", "rule_id": "c", "category": "validity", "column": "amount",
         "description": "d", "check_kind": "range", "params": {"low": "0"}},
    ]))
    found = {r.rule_id: r for r in catalogues.read_rule_catalogue(spark, str(rule_file)).collect()}
    assert (found["a"].check_kind, found["a"].params, found["a"].threshold_pct) == ("sql", {"sql_text": "SELECT 1"}, 100.0)
    assert (found["b"].params, found["b"].threshold_pct, found["b"].description) == ({"sql_text": "SELECT 2"}, 90.0, "")
    assert (found["c"].check_kind, found["c"].params, found["c"].column_name) == ("range", {"low": "0"}, "amount")
    metric_file.write_text(json.dumps([
        {"table_name": "orders", "sql_id": "m1", "purpose": "row_count", "expr": "count(*)"},
        {"table_name": "orders", "sql_id": "m2", "purpose": "row_count", "sql": "SELECT COUNT(*) + 1 FROM orders"},
        {"table_name": "orders", "sql_id": "m3", "purpose": "min_max", "column": "amount",
         "sql_text": "SELECT MIN(amount), MAX(amount) FROM orders"},
        {"table_name": "orders", "sql_id": "m4", "purpose": "distinct", "column": "amount", "expr": "oops(amount)"},
        {"table_name": "orders", "sql_id": "m6", "purpose": "row_count", "sql": "DROP VIEW orders"},
        {"table_name": "absent", "sql_id": "m5", "purpose": "row_count", "expr": "count(*)"},
    ]))
    specs = catalogues.read_metric_catalogue(spark, str(metric_file)).collect()
    results = custom_metrics(sample, specs)
    assert {r.sql_id: r.status for r in results.collect()} == {
        "m1": "executed", "m2": "executed", "m3": "executed", "m4": "failed", "m5": "failed",
        "m6": "failed",
    }
    assert results.where("sql_id = 'm6'").first().error_class == "permission"
    summary = summarise_metrics(results).where("column_name = 'amount'").first()
    assert (summary.row_count, summary.min_value, summary.max_value) == (11, "-3.1", "312.4")
    assert summary.distinct_count is None


def test_report_files(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.lit("a"))
    written = reports.write_report({"one": df, "two": df}, str(tmp_path), "json")
    assert [spark.read.json(w).count() for w in written] == [3, 3]
