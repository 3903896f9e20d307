import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators.checks import rule, rule_counts, rules_frame, run_rules
from tablegauge.operators.profile import profile_schema
from tablegauge.operators.rules import derive_and_settle, derive_rules, settle_rules

KEYS = [None, 1, 1, 1, 1, 2, 2, 3, None, 9]


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(11)
    child = [(KEYS[i % len(KEYS)], rng.randint(0, 5), rng.choice(["a", None, "b", ""])) for i in range(400)]
    parent = [(1, 3), (2, 1), (3, 4), (3, 2), (None, 0)]
    return {
        "child": spark.createDataFrame(child, "k INT, n INT, s STRING").repartition(6),
        "parent": spark.createDataFrame(parent, "id INT, low INT"),
    }


def counted(tables, *rules):
    return {r.rule_id: r.violations for r in rule_counts(tables, list(rules)).collect()}


def test_row_and_group_checks_against_plain_python(spark, shop):
    rows = [tuple(r) for r in shop["child"].collect()]
    parents = {r.id: 1 for r in shop["parent"].collect() if r.id is not None}
    pairs = [r for r in shop["parent"].collect()]

    def excess(keys):
        return len(keys) - len(set(keys))

    expected = {
        "null": sum(k is None for k, _, _ in rows),
        "set": sum(s is not None and s not in ("a", "") for _, _, s in rows),
        "range": sum(n < 1 or n > 4 for _, n, _ in rows),
        "blank": sum(s == "" for _, _, s in rows),
        "pattern": sum(s is not None and s != "a" for _, _, s in rows),
        "unique": excess([k for k, _, _ in rows]),
        "key": excess([(k, s) for k, _, s in rows]),
        "orphan": sum(k is not None and k not in parents for k, _, _ in rows),
        "joined": sum(k is not None and p.id == k and n < p.low for k, n, _ in rows for p in pairs),
    }
    found = counted(
        shop,
        rule("child", "null", "completeness", "k"),
        rule("child", "set", "allowed_set", "s", values="a|"),
        rule("child", "range", "range", "n", low="1", high="4"),
        rule("child", "blank", "not_blank", "s"),
        rule("child", "pattern", "pattern", "s", pattern="^a$"),
        rule("child", "unique", "uniqueness", "k"),
        rule("child", "key", "natural_key", columns="k|s"),
        rule("child", "orphan", "orphans", "k", parent="parent", parent_column="id"),
        rule("child", "joined", "joined_predicate", "k", parent="parent", parent_column="id",
             uses="n", parent_uses="low", predicate="c.n < p.low"),
    )
    assert found == expected


def test_checks_of_an_empty_table(spark):
    tables = {"t": spark.createDataFrame([], "id INT, ts TIMESTAMP")}
    found = counted(
        tables,
        rule("t", "rows", "non_empty"),
        rule("t", "unique", "uniqueness", "id"),
        rule("t", "fresh", "freshness", "ts", as_of="TIMESTAMP '2024-01-01 00:00:00'", max_lag="1 DAY"),
        rule("t", "sigma", "sigma_range", "id"),
    )
    assert found == {"rows": 1, "unique": 0, "fresh": 0, "sigma": 0}


def test_failures_stay_apart(spark, shop):
    rules = [
        rule("child", "good", "completeness", "k"),
        rule("child", "column", "completeness", "nothing"),
        rule("child", "cast", "predicate", predicate="CAST(s AS INT) > 1"),
        rule("child", "parse", "predicate", predicate="n >"),
        rule("child", "write", "sql", sql_text="DELETE FROM child"),
        rule("child", "two", "sql", sql_text="SELECT 1; SELECT 2"),
        rule("child", "sum", "sql", sql_text="SELECT ' 41.9 ' FROM child"),
        rule("absent", "table", "completeness", "k"),
        rule("child", "kind", "guess", "k"),
        rule("child", "param", "allowed_set", "s"),
    ]
    found = {r.rule_id: r for r in run_rules(spark, shop, rules_frame(spark, rules)).collect()}
    assert (found["good"].status, found["good"].violations, found["good"].row_count) == ("executed", 80, 400)
    assert found["sum"].violations == 41
    classes = {i: (r.error_class, r.validated) for i, r in found.items() if r.status == "failed"}
    assert classes == {
        "column": ("missing_object", False),
        "cast": ("type_mismatch", True),
        "parse": ("syntax", False),
        "write": ("permission", False),
        "two": ("permission", False),
        "table": ("missing_object", False),
        "kind": ("missing_object", False),
        "param": ("missing_object", False),
    }
    assert all(r.violations is None for r in found.values() if r.status == "failed")


def test_settled_counts_equal_counts_from_the_tables(spark, sample):
    profile = profile_schema(sample).persist()
    rules = derive_rules(profile)
    settled = {r.rule_id: r.violations for r in settle_rules(rules, profile).collect()}
    at_once = {r.rule_id: r.violations for r in derive_and_settle(profile).collect()}
    run = {r.rule_id: r.violations for r in run_rules(spark, sample, rules).collect()}
    assert settled == at_once == run
    assert len(run) == 26


def test_rules_need_their_reason(spark):
    df = spark.createDataFrame(
        [
            ("t", 1, "paid", "int", True, 10, 4, 3),
            ("t", 2, "note", "string", True, 10, 1, 9),
            ("t", 3, "Code", "string", True, 10, 0, 10),
            ("t", 4, "price", "string", True, 10, 1, 9),
            ("t", 5, "unknown", "string", True, 10, None, None),
            ("t", 6, "E_Mail_email_total", "double", False, 10, 5, 2),
        ],
        "table_name STRING, ordinal INT, column_name STRING, dtype STRING, nullable BOOLEAN, "
        "row_count BIGINT, null_count BIGINT, distinct_count BIGINT",
    ).selectExpr("*", "CAST(NULL AS BIGINT) AS miss_count", "CAST(NULL AS BIGINT) AS negative_count")
    found = [r.rule_id for r in derive_rules(df).orderBy("rule_seq").collect()]
    assert found == [
        "t.consistency.non_empty",
        "t.completeness.paid",
        "t.completeness.Code",
        "t.uniqueness.Code",
        "t.completeness.unknown",
        "t.completeness.E_Mail_email_total",
        "t.validity.E_Mail_email_total",
    ]
    unchecked = derive_and_settle(df).where(F.col("status") == "validated").collect()
    assert [r.rule_id for r in unchecked if "unknown" in r.rule_id] == ["t.completeness.unknown"]


def test_empty_table_gets_no_uniqueness_rule(spark):
    tables = {"t": spark.createDataFrame([], "id INT")}
    found = [tuple(r) for r in derive_and_settle(profile_schema(tables)).select("rule_id", "violations").collect()]
    assert found == [("t.consistency.non_empty", 1), ("t.completeness.id", 0)]
