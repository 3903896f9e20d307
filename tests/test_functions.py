import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tablegauge.functions.numbers import (
    one_decimal,
    one_decimal_text,
    score_pct,
    share_pct,
    thousands,
    to_long_or,
    whole_text,
)
from tablegauge.functions.text import (
    classify_error_column,
    group_key_sql,
    lint_column,
    payload_digest,
    shorten,
    table_cell,
    value_shape,
)

LINT = {
    "SELECT 1": "ok",
    "select 'drop it'": "ok",
    "SELECT 1; DELETE FROM t": "ddl_dml",
    "DROP TABLE x": "bad_start",
    "-- note\nSELECT 1": "bad_start",
    "SELECT ';'": "multi",
    "SELECT replace(a, 'b', 'c') FROM t": "ddl_dml",
    "EXPLAIN SELECT 1": "ok",
    "SELECT 1;": "ok",
    "SELECT 1 ;; \n": "ok",
    "SELECT 1 ; ;": "multi",
    "SELECT 1; SELECT 2": "multi",
    "SELECT 'it''s; an update' FROM t": "multi",
    "SELECT 'it''s an update' FROM t": "ok",
    "WITH x AS (SELECT 1) SELECT * FROM x /* drop\ntable */": "ok",
    "SELECT 1 -- create\nFROM t": "ok",
    "SELECT 'open literal drop": "ddl_dml",
    "selected 1": "bad_start",
    "": "bad_start",
}

ERRORS = {
    'near "group": syntax error': "syntax",
    "unrecognized token: @": "syntax",
    "no such table: t": "missing_object",
    'column "x" does not exist': "missing_object",
    "Type mismatch in comparison": "type_mismatch",
    "invalid value for type date": "type_mismatch",
    "permission denied": "permission",
    "attempt to write a read-only database": "permission",
    "statement timed out": "timeout",
    "query canceled": "timeout",
    "table not found because of a timeout": "missing_object",
    "disk full": "unknown",
    None: "unknown",
}


def single(spark, values, ddl, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {ddl}")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_lint(spark):
    assert single(spark, list(LINT), "STRING", lint_column(F.col("v"))) == list(LINT.values())


def test_lint_of_long_literals(spark):
    text = "SELECT '" + "drop it ''now'' " * 20_000 + "'"
    assert single(spark, [text], "STRING", lint_column(F.col("v"))) == ["ok"]


def test_error_classes(spark):
    found = single(spark, list(ERRORS), "STRING", classify_error_column(F.col("v")))
    assert found == list(ERRORS.values())


@pytest.mark.parametrize(
    ("ddl", "values", "expected"),
    [
        (
            "STRING",
            [" 12.9 ", "abc", None, "-3", "1e3", "", "7d", "-0.5", ".5", "5."],
            [12, 0, 0, -3, 1000, 0, 0, 0, 0, 5],
        ),
        ("DOUBLE", [2.9, -2.9, None], [2, -2, 0]),
        ("BOOLEAN", [True, False, None], [1, 0, 0]),
        ("BIGINT", [5, None], [5, 0]),
        ("ARRAY<STRING>", [["4.2", "x"], [], None], [4, 0, 0]),
        ("ARRAY<ARRAY<INT>>", [[[3, 4]], [[]], []], [3, 0, 0]),
        ("DATE", [None], [0]),
    ],
)
def test_coercion(spark, ddl, values, expected):
    dtype = spark.createDataFrame([], f"v {ddl}").schema["v"].dataType
    assert single(spark, values, ddl, to_long_or(F.col("v"), dtype, 0)) == expected


def test_coercion_default(spark):
    dtype = spark.createDataFrame([], "v STRING").schema["v"].dataType
    assert single(spark, ["x", "4"], "STRING", to_long_or(F.col("v"), dtype, None)) == [None, 4]


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(7)
    values = [6.25, 0.35, 0.05, 0.15, 0.25, 66.65, 88.45, 0.0, 100.0]
    values += [rng.randint(0, 10_000) / rng.randint(1, 10_000) * 100.0 for _ in range(500)]
    assert single(spark, values, "DOUBLE", one_decimal(F.col("v"))) == [round(v, 1) for v in values]
    assert single(spark, values, "DOUBLE", one_decimal_text(F.col("v"))) == [
        f"{v:.1f}" for v in values
    ]
    halves = [0.5, 1.5, 2.5, 33.333, 10.5]
    assert single(spark, halves, "DOUBLE", whole_text(F.col("v"))) == [f"{v:.0f}" for v in halves]
    assert single(spark, [1234567, 12], "BIGINT", thousands(F.col("v"))) == ["1,234,567", "12"]


def test_shares_of_nothing(spark):
    df = spark.createDataFrame([(1, 4), (0, 0), (None, 3), (1, None)], "a BIGINT, b BIGINT")
    rows = df.select(
        share_pct(F.col("a"), F.col("b")).alias("share"),
        score_pct(F.col("a"), F.col("b"), 100.0).alias("score"),
    ).collect()
    assert [r.share for r in rows] == [25.0, 0.0, 0.0, 0.0]
    assert [r.score for r in rows] == [25.0, 100.0, None, 100.0]


def test_text_cells(spark):
    assert single(spark, ["abcdef", "abc", None], "STRING", shorten(F.col("v"), 3)) == [
        "abc...", "abc", None,
    ]
    assert single(spark, ["a|b\nc"], "STRING", table_cell(F.col("v"))) == ["a\\|b c"]
    assert single(spark, ["Ab-12 é"], "STRING", value_shape(F.col("v"))) == ["AA-99 é"]


def test_digest_matches_sorted_json(spark):
    rows = [(3, 'say "hi"\n', True), (None, "x", None)]
    df = spark.createDataFrame(rows, "n INT, text STRING, flag BOOLEAN")
    found = [r.d for r in df.select(payload_digest(["text", "n", "flag"]).alias("d")).collect()]
    expected = [
        hashlib.sha256(
            json.dumps({"n": n, "text": t, "flag": f}, sort_keys=True).encode()
        ).hexdigest()[:12]
        for n, t, f in rows
    ]
    assert found == expected


def test_group_key_keeps_values_apart(spark):
    long = "x" * 49
    texts = ["x" * 48, long, hashlib.sha256(long.encode()).hexdigest(), long, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "v STRING")
    key = F.expr(group_key_sql("v", True))
    assert df.select(F.count_distinct(key)).first()[0] == 4
    assert df.groupBy(key).count().count() == 5
