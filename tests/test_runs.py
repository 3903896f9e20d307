"""Runs survive failing saves, share what forks leave unchanged, and clean up after themselves."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablegauge.sources import runs

LAYOUT = "table_name STRING, stage STRING, blocked_at STRING, n INT"


def entities(spark, n):
    rows = [("a", "reviewed", None, n), ("b", "blocked", "G2", n)]
    return {name: spark.createDataFrame(rows, LAYOUT) for name in runs.ENTITIES}


def contents(loaded):
    return {name: sorted(map(str, df.collect())) for name, df in loaded.items()}


@pytest.mark.parametrize("bad", runs.ENTITIES)
def test_a_save_that_fails_leaves_the_run_whole(spark, tmp_path, bad):
    root = str(tmp_path)
    runs.save_run("r", entities(spark, 1), root)
    before = contents(runs.load_run(spark, "r", root))
    broken = entities(spark, 2)
    broken[bad] = broken[bad].withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(PySparkException):
        runs.save_run("r", broken, root)
    assert contents(runs.load_run(spark, "r", root)) == before
    left = runs.clean_run(spark, "r", root)
    # The entities before the failing one were written, and perhaps a part of it.
    assert len(left) - runs.ENTITIES.index(bad) in (0, 1)
    assert contents(runs.load_run(spark, "r", root)) == before


def test_a_failing_commit_leaves_the_run_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    runs.save_run("r", entities(spark, 1), root)
    before = contents(runs.load_run(spark, "r", root))

    def fail(*args):
        raise OSError("gone")

    monkeypatch.setattr(runs, "_commit", fail)
    for change in (lambda: runs.save_run("r", entities(spark, 2), root), lambda: runs.fork_run(spark, "r", "s", root, reset="a")):
        with pytest.raises(OSError):
            change()
    assert contents(runs.load_run(spark, "r", root)) == before
    with pytest.raises(runs.NoSuchRun):
        runs.load_run(spark, "s", root)
    monkeypatch.undo()
    assert len(runs.clean_run(spark, "s", root)) == len(runs.ENTITIES) - 1


def test_a_part_of_a_run_is_saved_beside_the_rest(spark, tmp_path):
    root = str(tmp_path)
    runs.save_run("r", entities(spark, 1), root)
    runs.save_run("r", {"gates": entities(spark, 7)["gates"]}, root)
    found = {name: df.first().n for name, df in runs.load_run(spark, "r", root).items()}
    assert found == {name: 7 if name == "gates" else 1 for name in runs.ENTITIES}
    runs.save_run("part", {"gates": entities(spark, 3)["gates"]}, root)
    assert runs.load_run(spark, "part", root, ("gates",))["gates"].count() == 2
    with pytest.raises(runs.NoSuchRun):
        runs.load_run(spark, "part", root)


def versions(root, run_id, entity="gates"):
    folder = f"{root}/{entity}/run_id={run_id}"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_old_versions_go_and_forks_keep_theirs(spark, tmp_path):
    root = str(tmp_path)
    runs.save_run("r", entities(spark, 1), root)
    forked = runs.fork_run(spark, "r", "f", root)
    assert versions(root, "f") == [] and contents(forked) == contents(runs.load_run(spark, "r", root))
    for n in range(2, 7):
        runs.save_run("r", entities(spark, n), root)
    # The newest two, and the one that the fork refers to.
    assert len(versions(root, "r")) == runs.KEPT + 1
    assert {df.first().n for df in runs.load_run(spark, "f", root).values()} == {1}
    assert {df.first().n for df in runs.load_run(spark, "r", root).values()} == {6}
    assert len(os.listdir(f"{root}/commits/run_id=r")) == runs.KEPT
    for n in range(10, 13):
        runs.save_run("f", entities(spark, n), root)
    assert {df.first().n for df in runs.load_run(spark, "f", root).values()} == {12}
    # With the fork's last reference the shared version went too; nothing is left to clean.
    assert len(versions(root, "r")) == runs.KEPT
    assert runs.clean_run(spark, "r", root) == []


def test_a_fork_writes_only_what_it_resets(spark, tmp_path):
    root = str(tmp_path)
    runs.save_run("r", entities(spark, 1), root)
    forked = runs.fork_run(spark, "r", "f", root, reset="a")
    assert versions(root, "f", "manifest") == [] and len(versions(root, "f")) == 1
    assert {r.table_name for r in forked["gates"].collect()} == {"b"}
    assert {r.table_name: r.stage for r in forked["table_states"].collect()} == {"a": "discovery", "b": "blocked"}
    assert forked["manifest"].count() == 2
    with pytest.raises(runs.NoSuchRun):
        runs.fork_run(spark, "absent", "g", root)


def test_two_writers_of_one_number_give_one_of_both_runs(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(runs, "_committed", lambda *args: (0, {}))
    runs.save_run("r", entities(spark, 1), root)
    runs.save_run("r", entities(spark, 2), root)
    monkeypatch.undo()
    assert len({df.first().n for df in runs.load_run(spark, "r", root).values()}) == 1
