import random

from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.sources.tables import discover, row_counts


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id INT, email STRING, amount DOUBLE")
    rows = by_column(P.profile_table(df, "t", top_k=2))
    assert [rows[c].row_count for c in ("id", "email", "amount")] == [0, 0, 0]
    assert rows["id"].distinct_count == 0 and rows["id"].min_num is None
    assert rows["email"].miss_count == 0 and rows["amount"].negative_count == 0


def test_odd_values(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, None, " "), (nan, None, ""), (-0.0, None, "\t"), (0.0, None, None), (nan, None, "a")],
        "x DOUBLE, nothing STRING, s STRING",
    )
    rows = by_column(P.profile_table(df, "t"))
    assert rows["x"].distinct_count == 3 and rows["x"].min_num == 0.0
    assert rows["x"].max_num != rows["x"].max_num
    assert (rows["nothing"].null_count, rows["nothing"].distinct_count) == (5, 0)
    assert (rows["nothing"].min_str, rows["nothing"].max_str) == (None, None)
    assert rows["s"].blank_count == 2


def test_odd_names_and_types(spark):
    df = spark.sql(
        "SELECT 1 AS `a.b`, 'x' AS `it's``q`, map('k', 1) AS m, array(1, 2) AS l, "
        "named_struct('f', 2) AS st, true AS ok, DATE'2024-01-01' AS d, 1.50BD AS price"
    )
    rows = by_column(P.profile_table(df, "odd'table", top_k=1))
    assert set(rows) == set(df.columns)
    assert {r.table_name for r in rows.values()} == {"odd'table"}
    assert rows["m"].distinct_count == 1 and rows["m"].min_str is None
    assert rows["price"].min_str == "1.50" and rows["price"].negative_count == 0
    assert rows["d"].max_str == "2024-01-01"
    assert [(t.value, t.n) for t in rows["it's`q"].top_values] == [("x", 1)]
    assert rows["m"].top_values is None


def test_modes_and_passes_agree(spark):
    rng = random.Random(3)
    data = [
        (i, rng.randint(0, 9), None if rng.random() < 0.2 else rng.choice(["a", "b" * 60, "c" * 60]))
        for i in range(500)
    ]
    df = spark.createDataFrame(data, "id INT, digit INT, text STRING").repartition(5)
    expected = {"id": 500, "digit": 10, "text": 3}
    for size in (1, 2, 4):
        found = by_column(P.profile_table(df, "t", columns_per_pass=size))
        assert {c: r.distinct_count for c, r in found.items()} == expected
    approx = by_column(P.profile_table(df, "t", mode="approx", rsd=0.02))
    assert abs(approx["id"].distinct_count - 500) <= 500 * 0.08
    assert approx["digit"].distinct_count == 10
    bare = by_column(P.profile_table(df, "t", mode="none", columns=["text", "id"]))
    assert [bare[c].ordinal for c in ("text", "id")] == [1, 2]
    assert bare["id"].distinct_count is None


def test_top_values_breaks_ties_by_value(spark):
    rows = [("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)]
    df = spark.createDataFrame(rows, "v STRING")
    found = P.top_values(df, ["v"], k=2).orderBy("rank").collect()
    assert [(r.rank, r.value, r.n) for r in found] == [(1, "c", 2), (2, "a", 1)]


def test_top_values_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    found = P.top_values(df, ["k"], k=3).orderBy("rank").collect()
    assert [(r.value, r.n) for r in found] == [("-1", 1000), ("1000", 1), ("1001", 1)]


def test_declared_not_null(spark, sample):
    found = P.profile_schema(sample, not_null={"customers": ["email"]}, mode="none")
    open_columns = found.where(~F.col("nullable")).select("table_name", "column_name").collect()
    assert [tuple(r) for r in open_columns] == [("customers", "email")]
    listed = discover(spark, sample, "s", not_null={"customers": ["email"]}, with_rows=True)
    row = listed.where("column_name = 'email'").first()
    assert (row.nullable, row.row_estimate, row.ordinal) == (False, 8, 3)


def test_row_counts(sample):
    found = {r.table_name: r.row_count for r in row_counts(sample).collect()}
    assert found == {"customers": 8, "orders": 10, "products": 5}


def test_report_of_missing_parts(spark):
    df = spark.createDataFrame(
        [("t", 1, "c", "string", True, None, None), ("t", 2, "d", "int", False, 0, 0),
         ("t", 3, "e", "int", False, 8, 1)],
        "table_name STRING, ordinal INT, column_name STRING, dtype STRING, nullable BOOLEAN, "
        "row_count BIGINT, null_count BIGINT",
    ).selectExpr(
        "*", "CAST(NULL AS BIGINT) AS distinct_count", "CAST(NULL AS STRING) AS min_str",
        "CAST(NULL AS STRING) AS max_str", "CAST(NULL AS DOUBLE) AS min_num",
        "CAST(NULL AS DOUBLE) AS max_num",
        "CAST(NULL AS ARRAY<STRUCT<value: STRING, n: BIGINT>>) AS top_values",
    )
    rows = by_column(P.column_profile_report(df))
    assert (rows["c"].null_pct, rows["c"].null_count, rows["c"].top_sample) == ("—", "—", "—")
    assert (rows["d"].null_pct, rows["d"].nullable) == ("0.0%", "NO")
    assert rows["e"].null_pct == "12.5%"


def test_free_text_types(spark):
    names = ["NUMERIC(10,2)", "integer", "money", "TEXT", None]
    df = spark.createDataFrame([(n,) for n in names], "d STRING")
    found = [r[0] for r in df.select(P.numeric_hint(F.col("d"))).collect()]
    assert found == [True, True, True, False, False]
