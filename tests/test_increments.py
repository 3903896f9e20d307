"""Profiles of growing tables: equal to those of the whole, and no part is read twice."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablegauge.operators import increments
from tablegauge.operators.profile import profile_table

LAYOUT = (
    "day INT, id BIGINT, email STRING, amount DOUBLE, price DECIMAL(9,2), flag BOOLEAN, born DATE, at TIMESTAMP, "
    "small SMALLINT, raw BINARY, tags ARRAY<STRING>, `odd name` STRING"
)


def rows(day, n, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    out = []
    for i in range(n):
        some = rng.random() > 0.2
        out.append((
            day, seed * 10_000 + i, rng.choice(["a@b.cd", "none", None, " "]), rng.choice([0.0, -0.0, 1.5, -2.0, None, float(rng.randint(0, 99))]),
            Decimal(rng.randint(-500, 500)) / 100 if some else None, rng.choice([True, False, None]), dt.date(2020, 1, 1 + rng.randint(0, 27)),
            dt.datetime(2020, 1, 1, rng.randint(0, 23)), rng.randint(-9, 9), bytes([rng.randint(0, 5)]), ["x", "y"][: rng.randint(0, 2)],
            rng.choice(["", "z", None]),
        ))
    return out


def table(spark, *parts):
    return spark.createDataFrame([r for part in parts for r in part], LAYOUT)


EXACT = ["ordinal", "column_name", "dtype", "nullable", "row_count", "null_count", "min_num", "max_num", "min_str", "max_str",
         "blank_count", "miss_count", "negative_count"]


def same(found, whole):
    a, b = ({r.column_name: r for r in df.collect()} for df in (found, whole))
    assert list(a) and set(a) == set(b)
    for name, row in b.items():
        assert [a[name][c] for c in EXACT] == [row[c] for c in EXACT], name
        if a[name].distinct_count is not None:
            assert abs(a[name].distinct_count - row.distinct_count) <= max(1, 4 * increments.SKETCH_ERROR * row.distinct_count), name
    assert {n for n, r in a.items() if r.distinct_count is None} <= {"tags"}


def test_increments_equal_the_whole_profile(spark, tmp_path):
    root, one, two, three = str(tmp_path / "kept"), rows(1, 300, 1), rows(2, 200, 2), rows(None, 50, 3)
    first = table(spark, one, two)
    same(increments.incremental_profile(first, "t", "day", root), profile_table(first.drop("day"), "t"))
    second = table(spark, one, two, three)
    assert increments.refresh_parts(second, "day", root) == 1
    assert increments.refresh_parts(second, "day", root) == 0
    found = increments.incremental_profile(second, "t", "day", root)
    same(found, profile_table(second.drop("day"), "t"))
    # A verdict of uniqueness hangs on the id, so it is exact.
    assert found.where("column_name = 'id'").first().distinct_count == 550
    # A part with other rows is read again, one that is gone does not count.
    third = table(spark, rows(1, 310, 4), three)
    assert increments.refresh_parts(third, "day", root) == 1
    same(increments.incremental_profile(third, "t", "day", root), profile_table(third.drop("day"), "t"))
    # As many rows as before, but others: read when asked to.
    fourth = table(spark, rows(1, 310, 5), three)
    assert increments.refresh_parts(fourth, "day", root) == 0
    assert increments.refresh_parts(fourth, "day", root, again=[1, None]) == 2
    same(increments.incremental_profile(fourth, "t", "day", root, exact=False), profile_table(fourth.drop("day"), "t"))


def test_only_new_partitions_are_scanned(spark, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "kept")
    table(spark, rows(1, 40, 1), rows(2, 40, 2)).write.partitionBy("day").parquet(path)
    increments.refresh_parts(spark.read.parquet(path), "day", root)
    table(spark, rows(3, 40, 3)).write.mode("append").partitionBy("day").parquet(path)
    # Old partitions get other rows, as many as before: read again, they would show.
    table(spark, rows(1, 40, 8), rows(2, 40, 9)).withColumn("price", F.col("price") + 999).where("day < 3").write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    now = spark.read.parquet(path)
    assert increments.refresh_parts(now, "day", root) == 1
    merged = increments.merged_profile(increments._stored(now, root), now, "t", "day")
    got = {r.column_name: r for r in merged.collect()}
    assert got["id"].row_count == 120 and got["id"].max_num == 30_039 and got["price"].max_num < 10


def test_many_changed_parts_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(increments, "NAMED_PARTS", 2)
    root, df = str(tmp_path / "kept"), table(spark, *(rows(d, 9, d) for d in range(1, 6)), rows(None, 9, 7))
    assert increments.refresh_parts(df, "day", root) == 6
    same(increments.incremental_profile(df, "t", "day", root), profile_table(df.drop("day"), "t"))


def test_a_failing_refresh_leaves_the_summaries(spark, tmp_path):
    root, one = str(tmp_path / "kept"), rows(1, 30, 1)
    increments.refresh_parts(table(spark, one), "day", root)
    broken = table(spark, one, rows(2, 30, 2)).withColumn("flag", F.when(F.col("day") == 2, F.raise_error(F.lit("lost")).cast("boolean")).otherwise(F.col("flag")))
    with pytest.raises(PySparkException):
        increments.refresh_parts(broken, "day", root)
    same(increments.incremental_profile(table(spark, one), "t", "day", root), profile_table(table(spark, one).drop("day"), "t"))


def test_an_empty_table(spark, tmp_path):
    df = table(spark, []).limit(0)
    found = increments.incremental_profile(df, "t", "day", str(tmp_path / "kept"))
    assert {(r.row_count, r.null_count) for r in found.collect()} == {(0, 0)}
