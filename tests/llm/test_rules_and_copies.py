"""Quality rules, exact copies: awkward rows, registered queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from check_results import normal
from tablegauge.llm.exact_dedup import exact_dedup
from tablegauge.llm.oracle import ORACLE
from tablegauge.llm.queries import QUERIES
from tablegauge.llm.quality_rules import BASE, BIT, FULL, Policy, ablations, apply_policy, ledger
from workbench.views import TABLES

from .awkward import CLASHES, DOC, PLAIN, ROWS, clashing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    result, relation = QUERIES[name](spark, FOLDER), db.sql(ORACLE[name])
    assert normal(result.columns, [tuple(r) for r in result.collect()]) == normal(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql_on_awkward_rows(spark, folder, name):
    items = [(1, "word7 ward7 w5x5"), (1, "TEXT of the same é"), (2, None), (None, "id"), (3, "")]
    path = folder(documents=(ROWS, DOC), benchmark=(items, "item_id long, text string"))
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    result, relation = QUERIES[name](spark, path), db.sql(ORACLE[name])
    assert normal(result.columns, [tuple(r) for r in result.collect()]) == normal(relation.columns, relation.fetchall())


def test_every_rule_is_evaluated_once_and_bits_add_up(spark):
    docs = spark.createDataFrame([(1, "A B | # $ %"), (2, PLAIN), (3, None), (4, "HEY YOU " * 40)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ledger(docs).collect()}
    assert rows[2].fail_bits == 0
    assert rows[3].n_words == 0 and rows[3].fail_bits == BIT["few_words"]
    assert rows[1].fail_bits == BIT["few_words"] | BIT["symbols"] | BIT["short_words"]
    assert rows[4].n_repeat_words == 80 and rows[4].fail_bits == BIT["repeated_windows"] | BIT["capitals"]


def test_windows_of_very_long_texts_are_counted_exactly(spark):
    """The hash is short there; equal hashes of unlike windows must not count."""
    n = 6_000_000
    words = f"array_join(transform(sequence(1, {n}), i -> conv(i, 10, 36)), ' ')"
    docs = spark.sql(f"SELECT 1 AS doc_id, {words} AS text UNION ALL SELECT 2, {words} || ' 1 2 3'")
    found = {r.doc_id: (r.n_words, r.n_repeat_words) for r in ledger(docs).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert found == {1: (n, 0), 2: (n + 3, 6)}


def test_colliding_hashes_do_not_hide_repeats(spark, monkeypatch):
    from tablegauge.llm import quality_rules

    # A hash of two values only: nearly all windows collide.
    short = quality_rules.repeat_words_sql("split(text, ' ')").replace("xxhash64(", "pmod(xxhash64(").replace("w[i + 2])", "w[i + 2]), 2)", 1)
    rows = ["a b c d a b c", "x y z x y z x y z", "p q r s t u v", "a b c x b c a b c", "a a a a", "b a a a b a a"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    got = [r.n for r in docs.selectExpr("text", f"{short} as n").collect()]
    want = []
    for text in rows:
        w = text.split(" ")
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want.append(len({j for i, r in enumerate(runs) if runs.count(r) > 1 for j in (i, i + 1, i + 2)}))
    assert got == want


def test_ablations_count_what_only_one_rule_rejects(spark):
    rows = spark.createDataFrame([(1,), (3,), (2,), (2,), (0,), (4,)], "fail_bits long")
    policy = Policy("two", ("few_words", "repeated_windows"))
    found = {r.rule: (r.n_failed, r.n_only) for r in ablations(rows, policy).collect()}
    assert found == {"few_words": (2, 1), "repeated_windows": (3, 2)}
    assert apply_policy(rows, policy).filter("kept").count() == 2
    assert FULL.mask & BASE.mask == BASE.mask


def test_rules_take_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    assert ledger(docs).count() == len(ROWS)
    assert ledger(docs.limit(0)).count() == 0


def test_copies_of_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC))
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by_id[1]] == [True] and by_id[1][0].group_size == 4
    assert sum(r.kept for r in by_id[2]) == 0 and {r.keep_id for r in by_id[2]} == {1}
    assert by_id[4][0].keep_id == 4 and by_id[5][0].keep_id == 4 and by_id[6][0].group_size == 1
    assert exact_dedup(docs.limit(0)).count() == 0


def test_of_rows_that_repeat_an_id_one_copy_stays(spark):
    docs = spark.createDataFrame([(7, "same"), (7, "same"), (None, "same")], "doc_id long, text string")
    rows = exact_dedup(docs).collect()
    assert sum(r.kept for r in rows) == 1 and {r.keep_id for r in rows} == {7}


def test_carried_columns_stay_with_their_row(spark):
    docs = clashing(spark.createDataFrame(ROWS, DOC)).withColumn("mark", F.md5(F.coalesce("text", F.lit("none"))))
    found = exact_dedup(docs, carry=("mark", *CLASHES[:1]))
    assert found.join(docs.select("mark").distinct(), "mark", "left_anti").count() == 0
