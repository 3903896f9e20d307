"""Catalogue rules of a web shop against a small fixture with planted defects."""

import datetime as dt

import pytest

from tablegauge import assess
from tablegauge.operators.checks import rule, rules_frame, run_rules


def day(n, hour=0):
    return dt.datetime(2024, 3, n, hour)


@pytest.fixture(scope="module")
def shop(spark):
    products = [
        (1, 100.0, 10.0, 90.0, '{"color": "red"}', day(1), day(2)),
        (2, 50.0, 0.0, 50.0, '{"color": ', day(1), day(1)),
        (3, 80.0, 25.0, 70.0, None, day(3), day(2)),
    ]
    orders = [
        (1, "ORD-2024-000001", "COMPLETED", None, 1),
        (2, "ORD-2024-000002", "COMPLETED", day(5), 1),
        (3, "ORD-24-3", "PENDING", None, 2),
        (4, "ORD-2024-000002", "PENDING", None, 9),
    ]
    items = [(1, 1, 1, 90.0, 2, 180.0), (2, 1, 2, 50.0, 1, 49.0), (3, 2, 7, 10.0, 0, 0.0), (4, 6, 1, 90.0, 1, 90.0)]
    reviews = [(1, 1, 5), (2, 1, 0), (3, 2, 6), (4, 2, None)]
    return {
        "products": spark.createDataFrame(
            products,
            "id INT, price DOUBLE, discount_percentage DOUBLE, final_price DOUBLE, "
            "specifications STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
        ),
        "orders": spark.createDataFrame(
            orders, "id INT, order_number STRING, status STRING, completed_at TIMESTAMP_NTZ, user_id INT"
        ),
        "order_items": spark.createDataFrame(
            items, "id INT, order_id INT, product_id INT, product_price DOUBLE, quantity INT, subtotal DOUBLE"
        ),
        "reviews": spark.createDataFrame(reviews, "id INT, product_id INT, rating INT"),
        "users": spark.createDataFrame([(1,), (2,)], "id INT"),
    }


CASES = (
    (rule("products", "final_price", "predicate", category="accuracy",
         predicate="abs(final_price - price * (1 - discount_percentage / 100)) > 0.005"), 1),
    (rule("products", "updated", "predicate", category="consistency", predicate="updated_at < created_at"), 1),
    (rule("products", "json", "predicate",
         predicate="specifications IS NOT NULL AND try_parse_json(specifications) IS NULL"), 1),
    (rule("order_items", "subtotal", "predicate", category="accuracy",
         predicate="abs(subtotal - product_price * quantity) > 0.005"), 1),
    (rule("order_items", "quantity", "range", "quantity", low="1"), 1),
    (rule("order_items", "order", "orphans", "order_id", parent="orders", parent_column="id"), 1),
    (rule("order_items", "product", "orphans", "product_id", parent="products", parent_column="id"), 1),
    (rule("order_items", "price", "joined_predicate", "product_id", parent="products",
         parent_column="id", uses="product_price", parent_uses="final_price",
         predicate="c.product_price <> p.final_price"), 0),
    (rule("orders", "completed", "predicate", category="consistency",
         predicate="status = 'COMPLETED' AND completed_at IS NULL"), 1),
    (rule("orders", "number", "pattern", "order_number", pattern=r"^ORD-\d{4}-\d{6}$"), 1),
    (rule("orders", "number_once", "uniqueness", "order_number", category="uniqueness"), 1),
    (rule("orders", "user", "orphans", "user_id", parent="users", parent_column="id"), 1),
    (rule("orders", "stale", "freshness", "completed_at", category="timeliness",
         as_of="TIMESTAMP_NTZ '2024-03-10 00:00:00'", max_lag="4 DAYS"), 1),
    (rule("reviews", "rating", "range", "rating", low="1", high="5"), 2),
)
RULES = [r for r, _ in CASES]
EXPECTED = {r.rule_id: n for r, n in CASES}


def test_shop_catalogue(spark, shop):
    found = run_rules(spark, shop, rules_frame(spark, RULES))
    assert {r.rule_id: r.violations for r in found.collect()} == EXPECTED
    assert {r.status for r in found.collect()} == {"executed"}


def test_shop_assessment(spark, shop):
    found = assess(spark, shop, catalogue=rules_frame(spark, RULES))
    assert {r.stage for r in found.table_states.collect()} == {"reviewed"}
    assert found.final_gate.first().state == "open"
    failed = {r.rule_id for r in found.judged.where("NOT passed").collect()}
    assert {i for i, n in EXPECTED.items() if n} <= failed
