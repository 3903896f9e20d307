import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators.checks import rule
from tablegauge.sources.audit_log import append_audit
from tablegauge.streaming import live
from workbench.queries import _weekly

RULES = (
    rule("t", "low", "range", "v", low="10"),
    rule("t", "null", "completeness", "v"),
)


def feed(spark, path, days, values):
    rows = [(dt.datetime(2024, 1, d, 12), v) for d, v in zip(days, values)]
    spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, v INT").coalesce(1).write.mode("append").parquet(path)


def test_counts_grow_with_the_log(spark, tmp_path):
    log, out, progress = (str(tmp_path / n) for n in ("log", "out", "progress"))
    layout = "agent STRING, outcome STRING"
    append_audit(spark.createDataFrame([("a", "ok"), ("a", "ok"), ("b", "error")], layout), log)

    def run():
        counts = live.live_activity(live.stream_audit(spark, log, files_per_batch=1))
        live.write_running_counts(counts, out, progress).awaitTermination()
        return {(r.agent, r.outcome): r.n for r in live.latest_counts(spark, out).collect()}

    assert run() == {("a", "ok"): 2, ("b", "error"): 1}
    append_audit(spark.createDataFrame([("a", "ok"), ("c", "ok")], layout), log)
    assert run() == {("a", "ok"): 3, ("b", "error"): 1, ("c", "ok"): 1}


def test_batches_are_checked_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    feed(spark, source, (1, 2, 3), (5, None, 50))
    schema = spark.read.parquet(source).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        live.write_batch_violations(stream, RULES, out, progress).awaitTermination()
        return {r.rule_id: (r.row_count, r.violations) for r in live.batch_totals(spark, out).collect()}

    assert run() == {"low": (3, 1), "null": (3, 1)}
    assert run() == {"low": (3, 1), "null": (3, 1)}
    feed(spark, source, (4,), (1,))
    assert run() == {"low": (4, 2), "null": (4, 1)}
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_windows_follow_event_time(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _check_windows(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _check_windows(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    feed(spark, source, (1, 1, 2), (5, 50, None))
    schema = spark.read.parquet(source).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        windows = live.windowed_violations(stream, RULES, "ts", "1 day", "2 days")
        live.write_windows(windows, out, progress).awaitTermination()
        found = live.latest_windows(spark, out).withColumn("day", F.dayofmonth(F.to_utc_timestamp("window_start", F.current_timezone())))
        return {(r.day, r.rule_id): (r.row_count, r.violations) for r in found.collect()}

    assert run() == {(1, "low"): (2, 1), (1, "null"): (2, 0), (2, "low"): (1, 0), (2, "null"): (1, 1)}
    feed(spark, source, (2, 9), (1, 20))
    later = run()
    assert later[(2, "low")] == (2, 1) and later[(1, "low")] == (2, 1) and later[(9, "low")] == (1, 0)


def test_only_row_rules_run_over_a_stream(spark):
    with pytest.raises(ValueError):
        live._row_rules([rule("t", "unique", "uniqueness", "v")])


GATES = "gate_id STRING, ts INT, state STRING, reason STRING"


def changes_by_hand(rows):
    out, last = [], {}
    for gate, ts, state, reason in sorted(rows, key=lambda r: r[1]):
        if gate not in last or last[gate] != (state, reason):
            out.append((gate, ts))
        last[gate] = (state, reason)
    return out


class Log:
    """Appends decisions to a log and runs the stream over what is new."""

    def __init__(self, spark, folder, lateness=None):
        self.spark, self.lateness = spark, lateness
        self.log, self.out, self.progress = (str(folder / n) for n in ("log", "out", "progress"))

    def run(self, *rows):
        self.spark.createDataFrame(rows, GATES).coalesce(1).write.mode("append").parquet(self.log)
        stream = self.spark.readStream.schema(GATES).option("maxFilesPerTrigger", 1).parquet(self.log)
        live.write_gate_changes(stream, self.out, self.progress, lateness=self.lateness).awaitTermination()
        return sorted((r.gate_id, r.ts) for r in live.read_gate_changes(self.spark, self.out).collect())


@pytest.mark.parametrize("lateness", [None, "3", "1000"])
def test_gate_changes_carry_over_batches(spark, tmp_path, lateness):
    run = Log(spark, tmp_path, lateness).run
    first = run(("G1", 1, "open", "a"), ("G2", 2, "closed", None), ("G1", 3, "open", "a"))
    assert first == [("G1", 1), ("G2", 2)]
    second = run(("G1", 4, "open", "a"), ("G2", 5, "closed", "late"), ("G3", 6, "open", None))
    assert second == [("G1", 1), ("G2", 2), ("G2", 5), ("G3", 6)]
    # A gate that a batch does not mention keeps its last decision.
    third = run(("G2", 7, "closed", "late"),)
    assert third == second
    assert run(("G1", 8, "open", "a"), ("G1", 9, "closed", "a")) == [("G1", 1), ("G1", 9), ("G2", 2), ("G2", 5), ("G3", 6)]


def test_a_late_decision_makes_and_unmakes_changes(spark, tmp_path):
    log = Log(spark, tmp_path)
    assert log.run(("G", 1, "open", None), ("G", 5, "open", None), ("G", 9, "closed", None)) == [("G", 1), ("G", 9)]
    # Closed in between: the next decision becomes a change. Closed before the last one: that is none any more.
    assert log.run(("G", 3, "closed", None),) == [("G", 1), ("G", 3), ("G", 5), ("G", 9)]
    assert log.run(("G", 7, "closed", None),) == [("G", 1), ("G", 3), ("G", 5), ("G", 7)]
    feed = [(r.batch_id, r.change, r.ts) for r in live.gate_change_feed(spark, log.out).collect()]
    assert sorted(feed) == [(0, "insert", 1), (0, "insert", 9), (1, "insert", 3), (1, "insert", 5), (2, "insert", 7), (2, "retract", 9)]


def test_any_order_of_files_gives_the_changes_of_the_log(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice(["G1", "G2", "G3", None]), ts, rng.choice(["open", "closed"]), rng.choice(["a", None])) for ts in range(120)]
    want = sorted(changes_by_hand(rows), key=str)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    log = Log(spark, tmp_path / "any")
    for at in range(0, 120, 30):
        spark.createDataFrame(shuffled[at : at + 30], GATES).coalesce(1).write.mode("append").parquet(log.log)
    stream = spark.readStream.schema(GATES).option("maxFilesPerTrigger", 1).parquet(log.log)
    live.write_gate_changes(stream, log.out, log.progress).awaitTermination()
    found = [(r.gate_id, r.ts) for r in live.read_gate_changes(spark, log.out).collect()]
    assert sorted(found, key=str) == want
    # Decisions up to ten late, settled after twelve: equal too, and the state stays small.
    near = sorted(rows, key=lambda r: r[1] + rng.randint(0, 10))
    log = Log(spark, tmp_path / "near", "12")
    for at in range(0, 120, 20):
        spark.createDataFrame(near[at : at + 20], GATES).coalesce(1).write.mode("append").parquet(log.log)
    stream = spark.readStream.schema(GATES).option("maxFilesPerTrigger", 1).parquet(log.log)
    live.write_gate_changes(stream, log.out, log.progress, lateness="12").awaitTermination()
    found = [(r.gate_id, r.ts) for r in live.read_gate_changes(spark, log.out).collect()]
    assert sorted(found, key=str) == want
    assert live.late_decisions(spark, log.out).isEmpty()
    for part in ("open", "current"):
        assert len([d for d in os.listdir(f"{log.out}/{part}") if d.startswith("batch_id")]) == live.KEPT
    left = spark.read.parquet(f"{log.out}/open")
    assert left.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 13 + 20 + 4


def test_decisions_later_than_that_are_set_aside(spark, tmp_path):
    log = Log(spark, tmp_path, "10")
    log.run(("G", 1, "open", None), ("G", 50, "closed", None))
    assert log.run(("G", 30, "closed", None), ("H", 2, "open", None), ("G", 60, "open", None), ("G", 45, "open", None)) == [
        ("G", 1), ("G", 50), ("G", 60)
    ]
    assert sorted(r.ts for r in live.late_decisions(spark, log.out).collect()) == [2, 30]


def test_a_batch_that_runs_again_replaces_its_output(spark, tmp_path, monkeypatch):
    log = Log(spark, tmp_path, "10")
    log.run(("G", 1, "open", None), ("G", 20, "closed", None))

    def fail(*args):
        raise OSError("lost")

    # The batch writes everything and fails before it is committed.
    log.run(("G", 25, "open", None))
    monkeypatch.setattr(live, "remove", fail)
    with pytest.raises(Exception, match="lost"):
        log.run(("G", 30, "closed", None), ("G", 31, "closed", None))
    monkeypatch.undo()
    assert log.run(("G", 33, "open", None)) == [("G", 1), ("G", 20), ("G", 25), ("G", 30), ("G", 33)]
    assert live.gate_change_feed(spark, log.out).count() == 5


def test_weekly_files_are_cut_by_all_tasks(spark):
    """A week is one file, but no task looks through the whole log for it."""
    rows = spark.range(0, 4000, 1, 4).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 700) AS ts", "'g' AS gate_id", "'open' AS state"
    )
    weeks = _weekly(rows)
    assert [w.rdd.getNumPartitions() for w in weeks] == [1] * 5
    assert all("Exchange" in w._jdf.queryExecution().executedPlan().toString() for w in weeks)
    assert sorted(r.event_id for w in weeks for r in w.collect()) == list(range(4000))
