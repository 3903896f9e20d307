import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablegauge import assess
from tablegauge.operators import gates as G
from tablegauge.operators.checks import rule, rules_frame
from tablegauge.operators.report import run_summary
from workbench.oracle import ORACLE
from workbench.queries import QUERIES

LOG = "table_name STRING, sql_id STRING, status STRING"


def one(df):
    row = df.first()
    return row.state, row.reason


def log(spark, *statuses):
    return spark.createDataFrame([("t", f"q{i}", s) for i, s in enumerate(statuses)], LOG)


def test_profile_gate(spark):
    assert one(G.gate_profile_execution(log(spark, "validated", "executed"))) == (
        "open", "Profile execution: all 2 SQLs for 't' validated",
    )
    pending = log(spark, "executed", "draft")
    assert one(G.gate_profile_execution(pending)) == (
        "closed", "Profile execution: 1 of 2 SQLs for 't' not validated",
    )
    failed = log(spark, *["failed"] * 7, "fixed")
    assert one(G.gate_profile_execution(failed)) == (
        "closed",
        "Profile execution: 8 of 8 SQLs for 't' not validated; "
        "unfixable after retries: q0, q1, q2, q3, q4, q5, q6",
    )
    assert one(G.gate_profile_execution(failed, listed=5))[1].endswith("q3, q4...")
    evidence = G.gate_profile_execution(failed).first().evidence
    assert evidence == {"failed": 7, "fixed": 1}
    assert G.gate_evidence(failed, "G2").where("status = 'failed'").count() == 7


def test_long_lists_of_failures_come_in_parts(spark):
    """Most failures under one table, cut over many tasks: parts are bounded, in order and whole."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = spark.range(30_000).selectExpr(
            "if(id % 50 = 0, concat('t', id % 3), 'hot') AS table_name", "concat('q', id) AS sql_id",
            "if(id % 7 = 0, 'executed', 'failed') AS status",
        )
        waivers = wide.where("sql_id LIKE '%9'").select("table_name", "sql_id")
        rows = G.failed_parts(wide, "G2", waivers, size=64).collect()
        want = {}
        for r in wide.where("status = 'failed' AND sql_id NOT LIKE '%9'").collect():
            want.setdefault(r.table_name, []).append(r.sql_id)
        assert {r.table_name for r in rows} == set(want)
        for table, ids in want.items():
            parts = sorted((r for r in rows if r.table_name == table), key=lambda r: r.part)
            assert [r.part for r in parts] == list(range(1, len(parts) + 1))
            assert all(r.n_ids == 64 for r in parts[:-1]) and 0 < parts[-1].n_ids <= 64
            assert ", ".join(r.names for r in parts) == ", ".join(sorted(ids))
        assert G.failed_parts(wide.limit(0), "G2").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_reasons_name_every_failed_statement(spark):
    n = 100_001
    items = spark.range(n).selectExpr("'t' AS table_name", "concat('q', id) AS sql_id", "'failed' AS status")
    every = ", ".join(sorted(f"q{i}" for i in range(n)))
    for gate in (G.gate_profile_execution, G.gate_rule_execution):
        assert one(gate(items))[1].endswith(f"; unfixable after retries: {every}")


def test_waived_statements_open_gates(spark):
    items = log(spark, "failed", "executed", "validated")
    waivers = spark.createDataFrame([("t", "q0"), ("u", "q2")], "table_name STRING, sql_id STRING")
    assert one(G.gate_rule_execution(items, waivers)) == (
        "open", "DQ execution: all 3 SQLs for 't' validated (1 waived)",
    )
    assert one(G.gate_rule_generation(items, waivers)) == (
        "closed",
        "Profiling incomplete for 't': 1 SQL(s) not executed (q2) - DQ rule generation stays locked",
    )
    assert one(G.gate_rule_generation(log(spark, "executed"))) == (
        "open", "Profiling complete for 't' (1 results) - DQ generation unlocked",
    )


def test_repeated_statements_and_waivers(spark):
    """A statement logged or waived again; `per_waiver` counts as a join of both logs does."""
    items = log(spark, "failed", "executed", "validated").union(log(spark, "failed"))
    waivers = spark.createDataFrame([("t", "q0"), ("t", "q0"), ("t", "q2")], "table_name STRING, sql_id STRING")
    for per_waiver, n, statuses in ((False, 4, [2, 1, 1]), (True, 6, [4, 1, 1])):
        g4 = G.gate_rule_execution(items, waivers, per_waiver=per_waiver)
        assert one(g4) == ("open", f"DQ execution: all {n} SQLs for 't' validated (3 waived)")
        g3 = G.gate_rule_generation(items, waivers, per_waiver=per_waiver)
        assert one(g3) == ("open", f"Profiling complete for 't' ({n} results) - DQ generation unlocked")
        for gate in (g4, g3):
            assert gate.first().evidence == dict(zip(("failed", "executed", "validated"), statuses))
        rows = G.gate_evidence(items, "G4", waivers, per_waiver)
        assert [rows.where(F.col("status") == s).count() for s in ("failed", "executed", "validated")] == statuses


@pytest.mark.parametrize("name", ["gate_g4_waived", "gate_g4_wide", "gate_evidence"])
def test_waived_queries_equal_their_sql_on_repeated_events(spark, tmp_path, name):
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    given.union(given).union(given.where("event_id % 2 = 0")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(ORACLE[name])
    found = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_review_gate_tolerates_some_failures(spark):
    checks = log(spark, "failed", "executed", "failed")
    assert one(G.gate_review(checks)) == (
        "closed", "'t': 2 DQ check(s) unresolved after 3 fix attempts (q0, q2) - review blocked",
    )
    assert one(G.gate_review(checks, max_unresolved=2))[0] == "open"


def test_first_and_last_gate(spark):
    empty = spark.createDataFrame([], "table_name STRING")
    assert one(G.gate_connection(empty, "s")) == ("closed", "No tables discovered in schema 's'")
    states = spark.createDataFrame([("b", "blocked"), ("a", "dq_gen"), ("c", "waived")], "table_name STRING, stage STRING")
    assert one(G.gate_final(states)) == (
        "closed",
        "Final report gate: 2 table(s) not reviewed (a, b) - report generated in PARTIAL mode",
    )
    assert G.report_mode(G.gate_final(states)).first().mode == "PARTIAL RUN"
    done = states.where("stage = 'waived'")
    assert one(G.gate_final(done)) == ("open", "All 1 tables reviewed - full report unlocked")


@pytest.mark.parametrize("slices", [None, 1, 3, 16])
def test_changes_of_a_hot_gate(spark, slices):
    rng = random.Random(5)
    rows, ts = [], 0
    for i in range(900):
        ts += rng.choice([0, 0, 1])
        gate = "hot" if rng.random() < 0.7 else f"g{rng.randint(0, 20)}"
        rows.append((i, ts, gate, rng.choice(["open", "closed"]), rng.choice([None, "r"])))
    seen, expected = {}, []
    for i, _, gate, state, reason in rows:
        if gate not in seen or seen[gate] != (state, reason):
            expected.append(i)
        seen[gate] = (state, reason)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "id INT, ts INT, gate_id STRING, state STRING, reason STRING")
    found = G.gate_changes(df, order=("ts", "id"), slices=slices)
    assert sorted(r.id for r in found.collect()) == expected


def test_a_table_stops_at_its_first_closed_gate(spark, sample):
    catalogue = rules_frame(
        spark,
        [
            rule("customers", "customers.validity.odd", "range", "nothing", low="1", seq=900),
            rule("orders", "orders.validity.cast", "predicate", predicate="CAST(status AS INT) = 1", seq=900),
        ],
    )
    found = assess(spark, sample, catalogue=catalogue)
    states = {r.table_name: (r.stage, r.blocked_at) for r in found.table_states.collect()}
    assert states == {
        "customers": ("blocked", "G4"),
        "orders": ("blocked", "G5"),
        "products": ("reviewed", None),
    }
    held = {r.table_name: (r.dq, r.gates) for r in run_summary(found.table_states, found.reviews, found.gates).collect()}
    assert held == {
        "customers": ("DQ pending", "G2=open, G3=open, G4=closed"),
        "orders": ("DQ pending", "G2=open, G3=open, G4=open, G5=closed"),
        "products": ("DQ 6/7 pass", "G2=open, G3=open, G4=open, G5=open"),
    }
    judged = found.judged
    assert judged.where("table_name <> 'products' AND passed IS NOT NULL").count() == 0
    assert judged.where("table_name = 'customers' AND violations IS NOT NULL").count() == 0
    assert judged.where("table_name = 'orders' AND violations = 1").count() == 1
    assert [r.table_name for r in found.reviews.collect()] == ["products"]


def test_tolerated_failure_leaves_a_rule_unchecked(spark, sample):
    catalogue = rules_frame(
        spark, [rule("orders", "orders.validity.cast", "predicate", predicate="CAST(status AS INT) = 1", seq=900)]
    )
    found = assess(spark, {"orders": sample["orders"]}, catalogue=catalogue, max_unresolved=1)
    review = found.reviews.first()
    assert (review.dq_pass, review.dq_fail) == (9, 1)
    assert found.judged.where(F.col("passed").isNull()).count() == 1


def test_an_unreadable_table_does_not_stop_the_others(spark, sample):
    broken = spark.range(5).selectExpr("id", "CAST(concat('x', id) AS INT) AS amount")
    catalogue = rules_frame(spark, [rule("broken", "broken.x", "completeness", "id")])
    found = assess(spark, sample | {"broken": broken}, catalogue=catalogue)
    states = {r.table_name: (r.stage, r.blocked_at) for r in found.table_states.collect()}
    assert states.pop("broken") == ("blocked", "G3")
    assert set(states.values()) == {("reviewed", None)} and len(states) == 3
    assert found.judged.where("passed IS NOT NULL").count() == 26
    failed = found.check_log.where("table_name = 'broken'").collect()
    assert {(r.status, r.error_class) for r in failed} == {("failed", "type_mismatch")}
    gates = {r.gate_id: r.state for r in found.gates.where("table_name = 'broken'").collect()}
    assert gates == {"G2": "open", "G3": "closed"}
    assert found.final_gate.first().reason.startswith("Final report gate: 1 table(s)")
