"""Counts by key: comparisons without a join, grouping rules from one shuffle, rules that run too long."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import checks, matching
from tablegauge.operators.checks import rule, rule_counts, rules_frame, run_rules
from tablegauge.operators.matching import inequality_pairs

HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def side(rng, n, keys=4, values=6):
    return [(rng.choice([None, *range(keys)]), rng.choice([None, *range(values)])) for _ in range(n)]


@pytest.mark.parametrize("sign", sorted(HOLDS))
def test_comparisons_equal_all_pairs(spark, sign):
    rng = random.Random(len(sign))
    for n, m in ((60, 50), (1, 40), (0, 9)):
        a, b = side(rng, n), side(rng, m)
        want = sum(k is not None and k == j and x is not None and y is not None and HOLDS[sign](x, y) for k, x in a for j, y in b)
        left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "j long, y long").withColumn("y", F.col("y").cast("double"))
        rules = [
            rule("a", "named", "inequality", "k", parent="b", parent_column="j", value="x", comparison=sign, parent_value="y"),
            rule("a", "plain", "joined_predicate", "k", parent="b", parent_column="j", uses="x", parent_uses="y", predicate=f"c.x {sign} p.y"),
            rule("a", "turned", "joined_predicate", "k", parent="b", parent_column="j", uses="x", parent_uses="y",
                 predicate=f" p.`y` {checks.TURNED[sign]} c.x "),
            rule("a", "joined", "joined_predicate", "k", parent="b", parent_column="j", uses="x", parent_uses="y", predicate=f"(c.x {sign} p.y)"),
        ]
        found = {r.rule_id: r.violations for r in rule_counts({"a": left, "b": right}, rules).collect()}
        assert found == dict.fromkeys(("named", "plain", "turned", "joined"), want)


def test_a_key_hot_on_both_sides_is_counted_without_a_join(spark):
    n = 100_000
    child = spark.range(n).selectExpr("1 AS k", "id AS x")
    parent = spark.range(n).selectExpr("1 AS k", "id + id % 2 AS y")
    found = inequality_pairs(child, "k", F.col("x"), "<", parent, "k", F.col("y"))
    assert "Join" not in plan(found) and "CartesianProduct" not in plan(found)
    start = time.time()
    # Parents hold 0, 2, 2, 4, 4, ...: each 2i has 2i smaller children, or all of them beyond the end.
    want = sum(min(i + i % 2, n) for i in range(n))
    assert found.first().violations == want
    assert time.time() - start < 60


def test_ranges_cut_a_key_and_carry_over(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rng = random.Random(2)
        a = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 300)) for _ in range(800)]
        b = [(rng.choice([1, 1, 1, 2, 4]), rng.randint(0, 300)) for _ in range(700)]
        left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, x int")
        for sign, holds in HOLDS.items():
            want = sum(k == j and holds(x, y) for k, x in a for j, y in b)
            assert inequality_pairs(left, "k", F.col("x"), sign, right, "k", F.col("x")).first().violations == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("heavy", [0, 150, 10_000])
def test_only_keys_of_heavy_buckets_are_cut_into_ranges(spark, monkeypatch, heavy):
    monkeypatch.setattr(matching, "HEAVY", heavy)
    rng = random.Random(heavy)
    for keys in ([1, 1, 1, 1, *range(2, 40)], ["hot", "hot", "hot", *map(str, range(20))]):
        a = [(rng.choice(keys), rng.choice([None, *range(9)])) for _ in range(1200)]
        b = [(rng.choice(keys), rng.choice([None, *range(9)])) for _ in range(900)]
        kind = "int" if keys[0] == 1 else "string"
        left, right = (spark.createDataFrame(rows, f"k {kind}, x int") for rows in (a, b))
        for sign, holds in HOLDS.items():
            want = sum(k == j and None not in (x, y) and holds(x, y) for k, x in a for j, y in b)
            assert inequality_pairs(left, "k", F.col("x"), sign, right, "k", F.col("x")).first().violations == want


def test_rows_of_ordinary_keys_are_not_cut_into_ranges(spark, monkeypatch):
    given, ranged = matching._met_in_ranges, []
    monkeypatch.setattr(matching, "_met_in_ranges", lambda rows, ties: ranged.append(rows) or given(rows, ties))
    left = spark.range(20_000).selectExpr("id % 5000 AS k", "id AS x")
    right = spark.range(5000).selectExpr("id AS k", "10000 AS x")
    found = inequality_pairs(left, "k", F.col("x"), "<", right, "k", F.col("x"))
    assert found.first().violations == 10_000
    assert len(ranged) == 1 and ranged[0].count() == 0


def test_unlike_types_are_joined_or_refused(spark):
    tables = {"a": spark.createDataFrame([(1, "10")], "k int, x string"), "b": spark.createDataFrame([(1, 9)], "k int, y int")}
    common = {"parent": "b", "parent_column": "k"}
    joined = rule("a", "j", "joined_predicate", "k", uses="x", parent_uses="y", predicate="c.x > p.y", **common)
    named = rule("a", "i", "inequality", "k", value="x", comparison=">", parent_value="y", **common)
    odd = rule("a", "o", "inequality", "k", value="x", comparison="<>", parent_value="y", **common)
    found = {r.rule_id: r for r in run_rules(spark, tables, rules_frame(spark, [joined, named, odd])).collect()}
    assert found["j"].violations == 1
    assert found["i"].status == found["o"].status == "failed" and not found["i"].validated


def keyed_rules():
    of = {"parent": "p", "parent_column": "id"}
    return [
        rule("c", "once", "uniqueness", "k"),
        rule("c", "once_big", "uniqueness", "k", where="n > 5"),
        rule("c", "lost", "orphans", "k", **of),
        rule("c", "lost_big", "orphans", "k", where="n > 5", **of),
        rule("c", "looked", "domain_lookup", "k", lookup="q", lookup_column="id"),
        rule("c", "key", "natural_key", columns="k"),
        rule("c", "pair", "natural_key", columns="k|n"),
        rule("c", "pair_big", "natural_key", columns="k|n", where="n > 5"),
        rule("c", "unlike", "orphans", "k", parent="p", parent_column="name"),
    ]


def keyed_tables(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3, 9, 12]), rng.choice([None, *range(9)])) for _ in range(500)]
    return {
        "c": spark.createDataFrame(rows, "k int, n int"),
        "p": spark.createDataFrame([(1, "1"), (2, "2"), (2, "x"), (None, None)], "id long, name string"),
        "q": spark.createDataFrame([(9,), (3,), (9,)], "id int"),
    }


def test_shared_key_counts_equal_those_alone(spark):
    tables, rules = keyed_tables(spark), [r for r in keyed_rules() if r.rule_id != "unlike"]
    alone = {r.rule_id: rule_counts(tables, [r]).first().violations for r in rules}
    together = {r.rule_id: r.violations for r in rule_counts(tables, rules).collect()}
    assert together == alone and len(set(alone.values())) > 5


def test_ten_rules_of_a_key_take_one_scan_and_one_shuffle(spark, tmp_path):
    for name, df in keyed_tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in "cpq"}
    rules = [r for r in keyed_rules() if r.rule_id in ("once", "once_big", "lost", "lost_big", "looked", "key")]
    batch = checks._Batch(tables, rules)
    (unit,) = batch.units()
    text = plan(batch.frame(unit))
    assert text.count("FileScan parquet") == 3 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_a_failing_rule_of_a_shared_key_fails_alone(spark):
    tables = keyed_tables(spark)
    broken = rule("c", "broken", "uniqueness", "k", where="1 / (n - n) > 0")
    lost = rule("c", "gone", "orphans", "k", parent="p", parent_column="absent")
    rules = [*keyed_rules()[:6], broken, lost]
    found = {r.rule_id: r for r in run_rules(spark, tables, rules_frame(spark, rules)).collect()}
    alone = {r.rule_id: rule_counts(tables, [r]).first().violations for r in keyed_rules()[:6]}
    assert {i: found[i].violations for i in alone} == alone
    assert (found["broken"].status, found["broken"].validated) == ("failed", True)
    assert (found["gone"].status, found["gone"].validated, found["gone"].error_class) == ("failed", False, "missing_object")
    assert {r.row_count for r in found.values()} == {500}


def test_a_rule_that_runs_too_long_is_stopped(spark):
    slow = spark.range(0, 4, 1, 4).withColumn("k", F.col("id")).withColumn(
        "busy", F.expr("aggregate(sequence(1, 40000000), 0L, (a, x) -> a + (x + k) % 7)")
    )
    tables = {"t": spark.createDataFrame([(1,), (1,)], "k int"), "slow": slow}
    rules = [rule("t", "fast", "uniqueness", "k"), rule("slow", "endless", "predicate", predicate="busy < 0")]
    found = {r.rule_id: r for r in run_rules(spark, tables, rules_frame(spark, rules), timeout_s=3).collect()}
    assert (found["fast"].status, found["fast"].violations) == ("executed", 1)
    assert (found["endless"].status, found["endless"].error_class, found["endless"].violations) == ("failed", "timeout", None)
