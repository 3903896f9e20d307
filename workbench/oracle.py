"""The registered queries as SQL, written against the given tables."""

import re

from workbench.views import TABLES, VIEWS

ORACLE: dict[str, str] = {}

# Columns of the profiled tables, with their Spark type names.
COLUMNS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "dirty_customer": "id bigint, name string, email string, segment string, sku string, total_amount double",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}
ASSESSED = ("dirty_customer", "events", "lineitem", "orders", "supplier")
NUMBERS = ("int", "bigint", "double")
QUANTITIES = ("amount", "price", "qty", "quantity", "total")
SCORED = ("completeness", "uniqueness", "validity", "consistency", "timeliness", "accuracy")


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in COLUMNS[table].split(",")]


def ctes(*names: str) -> list[str]:
    return [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})}\n)" for n in names if n in VIEWS]


def with_views(select: str, *more: str) -> str:
    """Prefix the views that the text uses."""
    body = "\n".join((*more, select))
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    parts = ctes(*used) + list(more)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def oracle(name: str, select: str, *more: str) -> None:
    ORACLE[name] = with_views(select, *more)


def union(selects) -> str:
    return "\nUNION ALL\n".join(selects)


def one_decimal(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


# ---- profile and rules as SQL -------------------------------------------------


def column_metrics(table: str, ordinal: int, name: str, dtype: str) -> str:
    number = dtype in NUMBERS
    zero = f"{name} + 0.0" if dtype == "double" else name
    email = "email" in name
    quantity = number and not email and any(q in name for q in QUANTITIES)
    low = f"CAST(min({zero}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    high = f"CAST(max({zero}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    if dtype in ("double", "array<float>"):
        low_text = high_text = "CAST(NULL AS VARCHAR)"
    else:
        low_text, high_text = f"CAST(min({name}) AS VARCHAR)", f"CAST(max({name}) AS VARCHAR)"
    blank = f"count(*) FILTER (trim({name}) = '')" if dtype == "string" else "CAST(NULL AS BIGINT)"
    miss = (
        f"count(*) FILTER ({name} IS NOT NULL AND {name} NOT LIKE '%_@_%._%')"
        if email
        else "CAST(NULL AS BIGINT)"
    )
    negative = f"count(*) FILTER ({name} < 0)" if quantity else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{table}' AS table_name, {ordinal} AS ordinal, '{name}' AS column_name,
  '{dtype}' AS dtype, TRUE AS nullable, count(*) AS row_count,
  count(*) FILTER ({name} IS NULL) AS null_count, count(DISTINCT {name}) AS distinct_count,
  {low} AS min_num, {high} AS max_num, {low_text} AS min_str, {high_text} AS max_str,
  {blank} AS blank_count, {miss} AS miss_count, {negative} AS negative_count,
  (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (
     SELECT count(*) AS n FROM {table} GROUP BY {name} HAVING count(*) > 1)) AS excess
FROM {table}"""


def profile_cte(tables) -> str:
    rows = [
        column_metrics(t, i, name, dtype)
        for t in tables
        for i, (name, dtype) in enumerate(columns(t), 1)
    ]
    return "profile AS (\n" + union(rows) + "\n)"


def _derived(place, kind, category, column, suffix, says, threshold, count, where) -> str:
    return f"""SELECT table_name, CAST(ordinal * 10 + {place} AS INTEGER) AS rule_seq,
  concat(table_name, '.{category}.', {suffix}) AS rule_id, {column} AS column_name,
  '{category}' AS category, {says} AS description, '{kind}' AS check_kind,
  CAST({threshold} AS DOUBLE) AS threshold_pct, {count} AS violations, row_count
FROM profile WHERE {where}"""


_QUANTITY = " OR ".join(f"lower(column_name) LIKE '%{q}%'" for q in QUANTITIES)
DERIVED = "derived AS (\n" + union(
    (
        _derived(-9, "non_empty", "consistency", "CAST(NULL AS VARCHAR)", "'non_empty'",
                 "concat(table_name, ' must contain rows')", 100,
                 "CAST(CASE WHEN row_count = 0 THEN 1 ELSE 0 END AS BIGINT)", "ordinal = 1"),
        _derived(1, "completeness", "completeness", "column_name", "column_name",
                 "concat(column_name, ' should be populated (>=99%)')", 99, "null_count",
                 "NOT nullable OR lower(column_name) LIKE '%id' OR COALESCE(null_count, 0) = 0"),
        _derived(2, "uniqueness", "uniqueness", "column_name", "column_name",
                 "concat(column_name, ' must be unique')", 100, "excess",
                 "row_count > 0 AND (distinct_count = row_count OR "
                 "lower(column_name) IN ('id', 'sku', 'code'))"),
        _derived(3, "email", "validity", "column_name", "column_name",
                 "concat(column_name, ' must look like an email')", 95, "miss_count",
                 "lower(column_name) LIKE '%email%'"),
        _derived(3, "non_negative", "validity", "column_name", "column_name",
                 "concat(column_name, ' must be >= 0')", 100, "negative_count",
                 f"lower(column_name) NOT LIKE '%email%' AND ({_QUANTITY}) "
                 "AND dtype IN ('int', 'bigint', 'double')"),
    )
) + "\n)"

SIGMA = """(SELECT count(*) FROM orders, (SELECT avg(o_totalprice) AS m,
   {k} * stddev_samp(o_totalprice) AS w FROM orders) b
   WHERE o_totalprice < m - w OR o_totalprice > m + w)"""
AHEAD = "(SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00')"
SHIPPED = """(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
   WHERE l_shipdate < o_orderdate)"""
LINE_KEY = """(SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n
   FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"""
ODD_STATUS = "(SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P'))"


#: Kinds of the catalogue's rules, by their place.
KINDS = {
    1001: "not_future",
    1002: "sigma_range",
    1003: "allowed_set",
    1004: "joined_predicate",
    1005: "natural_key",
    1006: "range",
}


def _extra(table, rule_id, column, category, description, threshold, seq, count) -> str:
    held = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{table}' AS table_name, {seq} AS rule_seq, '{rule_id}' AS rule_id,
  {held} AS column_name, '{category}' AS category, '{description}' AS description,
  '{KINDS[seq]}' AS check_kind, CAST({threshold} AS DOUBLE) AS threshold_pct,
  CAST({count} AS BIGINT) AS violations, (SELECT count(*) FROM {table}) AS row_count"""


CATALOGUE = (
    ("events", "events.timeliness.ts", "ts", "timeliness", "ts must not lie ahead", 90, 1001,
     AHEAD),
    ("orders", "orders.accuracy.total", "o_totalprice", "accuracy", "total within 1.5 sigma", 80,
     1002, SIGMA.format(k=1.5)),
    ("orders", "orders.validity.status", "o_orderstatus", "validity", "status is F, O or P", 100,
     1003, ODD_STATUS),
    ("lineitem", "lineitem.consistency.dates", "l_orderkey", "consistency",
     "shipped after the order", 99, 1004, SHIPPED),
    ("lineitem", "lineitem.uniqueness.key", None, "uniqueness", "one row per line", 100, 1005,
     LINE_KEY),
    ("supplier", "supplier.validity.rating", "s_rating", "validity", "rating from 1 to 5", 100,
     1006, "NULL"),
)

# The supplier rule does not resolve, so that table stops at G4: its checks
# stay uncounted and unjudged.
CHAIN = (
    profile_cte(ASSESSED),
    DERIVED,
    "found AS (\nSELECT * FROM derived\nUNION ALL\n" + union(_extra(*c) for c in CATALOGUE) + "\n)",
    """judged AS (
SELECT table_name, rule_seq, rule_id, column_name, category, description, check_kind, threshold_pct,
  row_count, CASE WHEN table_name <> 'supplier' THEN violations END AS violations,
  CASE WHEN rule_id = 'supplier.validity.rating' THEN 'failed'
       WHEN table_name = 'supplier' THEN 'validated' ELSE 'executed' END AS status,
  CASE WHEN table_name <> 'supplier'
       THEN violations <= row_count * (100.0 - threshold_pct) / 100.0 END AS passed
FROM found)""",
    """states AS (
SELECT table_name, CASE WHEN table_name = 'supplier' THEN 'blocked' ELSE 'reviewed' END AS stage,
  max(row_count) AS row_count, count(*) AS n_rules, count(*) FILTER (passed) AS dq_pass,
  count(*) FILTER (NOT passed) AS dq_fail, count(*) FILTER (passed IS NULL) AS unchecked
FROM judged GROUP BY table_name)""",
    f"""scored AS (
SELECT table_name, category, count(*) FILTER (passed) AS ok, count(*) AS total,
  {one_decimal('count(*) FILTER (passed) / count(*) * 100.0')} AS score
FROM judged WHERE passed IS NOT NULL GROUP BY table_name, category)""",
    """advice AS (
SELECT table_name, 1 AS part, rule_seq AS seq, concat(table_name, '.', COALESCE(column_name, '*'),
  ' [', category, '] FAILED: ', description, ' - ', CAST(violations AS VARCHAR), ' violation(s) (',
  printf('%.1f', violations / row_count * 100.0),
  '% of rows). Consider a constraint, backfill or upstream fix.') AS suggestion
FROM judged WHERE NOT passed
UNION ALL
SELECT table_name, 2 AS part, ordinal AS seq, concat(table_name, '.', column_name, ': ',
  printf('%.0f', null_count / row_count * 100.0),
  '% NULLs - evaluate NOT NULL + default, or drop the column.') AS suggestion
FROM profile WHERE row_count > 0 AND null_count / row_count > 0.10)""",
    """listed AS (
SELECT table_name, string_agg(suggestion, ' || ' ORDER BY part, seq) AS suggestions,
  string_agg(suggestion, ' || ' ORDER BY part, seq) FILTER (rn <= 4) AS first_four
FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY part, seq) AS rn FROM advice)
GROUP BY table_name)""",
)


def chain(name: str, select: str) -> None:
    oracle(name, select, *CHAIN)


# ---- tables and manifests -------------------------------------------------------

oracle(
    "row_counts_all",
    union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
)

_TYPE = """CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
  ELSE lower(column_type) END"""
_DESCRIBED = "described AS (\n" + union(
    f"""SELECT '{t}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name,
  {_TYPE} AS dtype, (SELECT count(*) FROM {t}) AS row_estimate FROM (DESCRIBE {t})"""
    for t in TABLES
) + "\n)"
oracle(
    "manifest",
    """SELECT 'main' AS schema_name, table_name, ordinal, column_name, dtype, TRUE AS nullable,
  row_estimate FROM described""",
    _DESCRIBED,
)
oracle(
    "manifest_sizes",
    """SELECT table_name, count(*) AS columns,
  count(*) FILTER (dtype IN ('int', 'bigint', 'double')) AS numeric_columns,
  1 + 2 * count(*) + count(*) FILTER (dtype IN ('int', 'bigint', 'double')) AS statements
FROM described GROUP BY table_name""",
    _DESCRIBED,
)
oracle(
    "profile_statement_log",
    """SELECT DISTINCT table_name, concat(table_name, '.row_count') AS sql_id,
  'row_count' AS purpose, CAST(NULL AS VARCHAR) AS column_name, 'executed' AS status FROM described
UNION ALL
SELECT table_name, concat(table_name, '.null_count.', column_name), 'null_count', column_name,
  'executed' FROM described
UNION ALL
SELECT table_name, concat(table_name, '.distinct.', column_name), 'distinct', column_name,
  'executed' FROM described
UNION ALL
SELECT table_name, concat(table_name, '.min_max.', column_name), 'min_max', column_name,
  'executed' FROM described WHERE dtype IN ('int', 'bigint', 'double')""",
    _DESCRIBED,
)

# ---- profiles -------------------------------------------------------------------

oracle(
    "null_counts",
    "SELECT table_name, column_name, row_count, null_count FROM profile",
    profile_cte(["dirty_customer"]),
)
oracle(
    "null_pct_band",
    """SELECT table_name, column_name, null_count,
  printf('%.1f', null_count / row_count * 100.0) AS null_pct,
  CASE WHEN null_count = 0 THEN 'success' WHEN null_count / row_count * 100.0 < 15 THEN 'warning'
       ELSE 'danger' END AS band
FROM profile""",
    profile_cte(["dirty_customer"]),
)
oracle("distinct_exact", "SELECT column_name, distinct_count FROM profile", profile_cte(["lineitem"]))
oracle("approx_within_error", "SELECT column_name, TRUE AS within FROM profile", profile_cte(["lineitem"]))
oracle("distinct_text", "SELECT column_name, distinct_count FROM profile", profile_cte(["documents"]))
oracle(
    "min_max_numeric",
    "SELECT column_name, min_num, max_num FROM profile WHERE dtype IN ('int', 'bigint', 'double')",
    profile_cte(["lineitem"]),
)
oracle(
    "min_max_any",
    "SELECT column_name, min_num, max_num, min_str, max_str FROM profile",
    profile_cte(["orders"]),
)
oracle(
    "blank_count",
    "SELECT column_name, blank_count FROM profile WHERE blank_count IS NOT NULL",
    profile_cte(["dirty_customer"]),
)


def _top(table: str, column: str, value: str | None = None, k: int = 5) -> str:
    value = value or column
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
  CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value, n
FROM (SELECT {value} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)
QUALIFY rank <= {k}"""


oracle(
    "top_values",
    union(
        [_top("orders", c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]
        + [_top("events", c) for c in ("event_type", "user_id", "props")]
    ),
)
oracle(
    "pattern_stats",
    "SELECT column_name, rank, value, n FROM (" + union(
        _top(
            "part", c,
            f"regexp_replace(regexp_replace({c}, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g')",
        )
        for c in ("p_name", "p_brand", "p_type")
    ) + ")",
)
_MEASURED = """SELECT table_name, ordinal, column_name, dtype, row_count, null_count,
  distinct_count, min_num, max_num, blank_count, negative_count FROM profile"""
oracle("profile_table_orders", _MEASURED, profile_cte(["orders"]))
oracle("profile_schema", _MEASURED, profile_cte(TABLES))
oracle(
    "column_profile_report",
    """SELECT table_name, ordinal, column_name, dtype,
  CASE WHEN column_name = 'id' THEN 'NO' ELSE 'YES' END AS nullable,
  CAST(null_count AS VARCHAR) AS null_count,
  concat(printf('%.1f', null_count / row_count * 100.0), '%') AS null_pct,
  CAST(distinct_count AS VARCHAR) AS distinct_count, COALESCE(min_str, printf('%.4f', min_num)) AS min_value,
  COALESCE(max_str, printf('%.4f', max_num)) AS max_value, CASE WHEN column_name NOT IN ('name', 'segment') THEN '—'
       WHEN length(sample) > 40 THEN concat(substr(sample, 1, 40), '...') ELSE sample END AS top_sample
FROM profile LEFT JOIN (
  SELECT column_name, string_agg(concat(value, ' (', CAST(n AS VARCHAR), ')'), ', ' ORDER BY rank)
    AS sample FROM tops GROUP BY column_name) USING (column_name)""",
    profile_cte(["dirty_customer"]),
    "tops AS (" + union(_top("dirty_customer", c, k=3) for c in ("name", "segment")) + ")",
)
oracle(
    "custom_metrics",
    """SELECT 'm.rows' AS sql_id, 'row_count' AS purpose, CAST(NULL AS VARCHAR) AS column_name,
  'executed' AS status, CAST(NULL AS VARCHAR) AS error_class, CAST(count(*) AS VARCHAR) AS cells
FROM orders
UNION ALL SELECT 'm.nulls', 'null_count', 'o_custkey', 'executed', NULL,
  CAST(count(*) FILTER (o_custkey IS NULL) AS VARCHAR) FROM orders
UNION ALL SELECT 'm.distinct', 'distinct', 'o_orderstatus', 'executed', NULL,
  CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'm.range', 'min_max', 'o_orderkey', 'executed', NULL,
  concat(CAST(min(o_orderkey) AS VARCHAR), ',', CAST(max(o_orderkey) AS VARCHAR)) FROM orders
UNION ALL SELECT 'm.top', 'top_values', 'o_orderpriority', 'executed', NULL,
  concat(value, ',', CAST(n AS VARCHAR)) FROM tops
UNION ALL SELECT 'm.blank', 'blank_count', 'o_orderstatus', 'executed', NULL,
  CAST(count(*) FILTER (trim(o_orderstatus) = '') AS VARCHAR) FROM orders
UNION ALL SELECT 'm.broken', 'distinct', 'o_nothing', 'failed', 'missing_object', NULL
UNION ALL SELECT 'm.cast', 'distinct', 'o_orderstatus', 'failed', 'type_mismatch', NULL
UNION ALL SELECT 'm.parts', 'row_count', NULL, 'executed', NULL, CAST(count(*) AS VARCHAR) FROM part
UNION ALL SELECT 'm.single', 'min', 'o_orderpriority', 'executed', NULL, min(o_orderpriority)
FROM orders""",
    "tops AS (" + _top("orders", "o_orderpriority", k=3) + ")",
)
oracle(
    "metric_summary",
    """SELECT 'orders' AS table_name, column_name, null_count, distinct_count, min_value, max_value,
  min_max, blank_count, (SELECT count(*) FROM orders) AS row_count,
  CASE WHEN column_name = 'o_orderpriority' THEN (SELECT string_agg(concat(value, '=',
    CAST(n AS VARCHAR)), ',' ORDER BY rank) FROM tops) END AS top_values FROM (
SELECT 'o_custkey' AS column_name, count(*) FILTER (o_custkey IS NULL) AS null_count,
  CAST(NULL AS BIGINT) AS distinct_count, CAST(NULL AS VARCHAR) AS min_value,
  CAST(NULL AS VARCHAR) AS max_value, CAST(NULL AS VARCHAR) AS min_max,
  CAST(NULL AS BIGINT) AS blank_count FROM orders
UNION ALL SELECT 'o_orderstatus', NULL, count(DISTINCT o_orderstatus), NULL, NULL, NULL,
  count(*) FILTER (trim(o_orderstatus) = '') FROM orders
UNION ALL SELECT 'o_orderkey', NULL, NULL, CAST(min(o_orderkey) AS VARCHAR),
  CAST(max(o_orderkey) AS VARCHAR), NULL, NULL FROM orders
UNION ALL SELECT 'o_orderpriority', NULL, NULL, NULL, NULL, min(o_orderpriority), NULL
FROM orders)
UNION ALL SELECT 'part', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), NULL FROM part""",
    "tops AS (" + _top("orders", "o_orderpriority", k=3) + ")",
)
oracle(
    "scalar_coercion",
    r"""SELECT event_id, CASE
  WHEN regexp_full_match(result, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
  THEN CAST(trunc(CAST(trim(result) AS DOUBLE)) AS BIGINT) ELSE 0 END AS as_count
FROM result_log_v""",
)

# ---- rules and checks -------------------------------------------------------------

_RULED = profile_cte(["dirty_customer", "orders", "part"])
oracle(
    "derive_rules",
    """SELECT table_name, rule_seq, rule_id, column_name, category, description, check_kind,
  threshold_pct FROM derived""",
    _RULED,
    DERIVED,
)
oracle(
    "settled_rules",
    "SELECT rule_id, check_kind, violations, row_count, 'executed' AS status FROM derived",
    _RULED,
    DERIVED,
)


def checks(name: str, **counts: str) -> None:
    """Violations per rule; a count is a condition `table: ...` or a subquery."""
    rows = []
    for rule_id, count in counts.items():
        if not count.startswith("("):
            table, condition = count.split(": ", 1)
            count = f"(SELECT count(*) FROM {table} WHERE {condition})"
        rows.append(f"SELECT '{rule_id}' AS rule_id, CAST({count} AS BIGINT) AS violations")
    oracle(name, union(rows))


def excess(table: str, keys: str) -> str:
    return f"""(SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT count(*) AS n FROM {table}
  GROUP BY {keys} HAVING count(*) > 1))"""


def orphans(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""(SELECT count(*) FROM {child} c WHERE c.{key} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key}))"""


checks(
    "chk_non_empty",
    **{
        "dirty_customer.non_empty": "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM dirty_customer)",
        "part.non_empty": "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM part)",
        "part.none_of_size_zero":
            "(SELECT CASE WHEN count(*) FILTER (p_size = 0) = 0 THEN 1 ELSE 0 END FROM part)",
    },
)
checks(
    "chk_completeness",
    **{
        f"dirty_customer.{c}": f"dirty_customer: {c} IS NULL"
        for c in ("id", "name", "email", "segment", "sku")
    },
    **{"dirty_orders.o_custkey": "dirty_orders: o_custkey IS NULL"},
)
checks(
    "chk_uniqueness",
    **{f"dirty_customer.{c}": excess("dirty_customer", c) for c in ("id", "email", "sku", "segment")},
    **{
        "documents.text": excess("documents", "text"),
        "part.p_brand": excess("part", "p_brand"),
    },
)
_MISS = "{0}: {1} IS NOT NULL AND {1} NOT LIKE '%_@_%._%'"
checks(
    "chk_email",
    **{
        "dirty_customer.email": _MISS.format("dirty_customer", "email"),
        "dirty_customer.name": _MISS.format("dirty_customer", "name"),
        "documents.text": _MISS.format("documents", "text"),
    },
)
checks(
    "chk_non_negative",
    **{
        "customer.c_acctbal": "customer: c_acctbal < 0",
        "supplier.s_acctbal": "supplier: s_acctbal < 0",
        "dirty_customer.total_amount": "dirty_customer: total_amount < 0",
        "lineitem.l_quantity": "lineitem: l_quantity < 0",
    },
)
checks(
    "chk_allowed_set",
    **{
        "orders.status": "orders: o_orderstatus NOT IN ('F', 'O')",
        "events.type": "events: event_type NOT IN ('click', 'view')",
        "dirty_customer.sku": "dirty_customer: sku NOT IN ('SKU-DUP')",
    },
)
checks(
    "chk_range",
    **{
        "part.size": "part: p_size < 5 OR p_size > 45",
        "lineitem.discount": "lineitem: l_discount > CAST(0.05 AS DOUBLE)",
        "orders.date": "orders: o_orderdate < TIMESTAMP '1995-01-01 00:00:00'",
    },
)
checks(
    "chk_regex",
    **{
        "pages.url": "pages: NOT regexp_matches(url, '^https://')",
        "dirty_customer.sku": "dirty_customer: NOT regexp_matches(sku, '^SKU-[0-9]+$')",
        "documents.text": "documents: NOT regexp_matches(text, '[.]$')",
    },
)
checks("chk_not_blank", **{"dirty_customer.segment": "dirty_customer: trim(segment) = ''"})
checks(
    "chk_not_future",
    **{
        "events.ts": "events: ts > TIMESTAMP '2024-01-20 00:00:00'",
        "orders.date": "orders: o_orderdate > TIMESTAMP '1998-01-01 00:00:00'",
    },
)
_STALE = "(SELECT CASE WHEN max({0}) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL {1} DAY THEN 1 ELSE 0 END FROM {2})"
checks(
    "chk_freshness",
    **{
        "events.fresh": _STALE.format("ts", 30, "events"),
        "orders.stale": _STALE.format("o_orderdate", 1, "orders"),
    },
)
_BEYOND = """(SELECT count(*) FROM {0}, (SELECT avg({1}) AS m, {2} * stddev_samp({1}) AS w FROM {0}) b
  WHERE {1} < m - w OR {1} > m + w)"""
checks(
    "chk_sigma_range",
    **{
        "lineitem.price": _BEYOND.format("lineitem", "l_extendedprice", 1.5),
        "orders.total": _BEYOND.format("orders", "o_totalprice", 1.0),
    },
)
checks(
    "chk_domain_lookup",
    **{
        "orders.status": "orders: o_orderstatus NOT IN (SELECT o_orderstatus FROM orders WHERE o_orderstatus <> 'P')",
        "customer.nation": orphans("customer", "c_nationkey", "nation", "n_nationkey"),
    },
)
checks(
    "chk_orphans",
    **{
        "dirty_orders.o_custkey": orphans("dirty_orders", "o_custkey", "customer", "c_custkey"),
        "lineitem.l_orderkey": orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
        "documents.unlabelled": orphans("documents", "doc_id", "labels", "doc_id"),
    },
)
checks(
    "chk_cross_column",
    **{
        "dirty_orders.completed": "dirty_orders: o_orderstatus = 'F' AND completed_at IS NULL",
        "dirty_orders.order": "dirty_orders: completed_at < o_orderdate",
        "lineitem.shipped": SHIPPED,
    },
)
_LATER = """(SELECT coalesce(sum(c.n * p.n), 0) FROM
  (SELECT l_linestatus AS k, l_shipdate AS v, count(*) AS n FROM lineitem GROUP BY ALL) c JOIN
  (SELECT o_orderstatus AS k, o_orderdate AS v, count(*) AS n FROM orders GROUP BY ALL) p ON c.k = p.k AND c.v < p.v)"""
# Of two rows of a type at least one is not less than the other; both ways count where values are equal.
_ORDERED = """(SELECT (sum(n * n) + sum(same)) // 2 FROM
  (SELECT k, sum(n) AS n, sum(n * n) AS same FROM
    (SELECT event_type AS k, value, count(*) AS n FROM events GROUP BY ALL) GROUP BY k))"""
_LATE = """(SELECT count(*) FROM events c JOIN events p ON c.user_id = p.user_id AND c.ts > p.ts
  WHERE c.event_type = 'error' AND p.event_type = 'view')"""
_DEARER = "(SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_totalprice <= l_extendedprice)"
checks(
    "chk_hot_inequality",
    **{
        "lineitem.before_orders": _LATER,
        "events.value_order": _ORDERED,
        "events.late_errors": _LATE,
        "orders.dearer_lines": _DEARER,
    },
)


def _of(where: str) -> str:
    return f"(SELECT * FROM dirty_orders WHERE {where})"


checks(
    "chk_shared_key",
    **{
        "dirty_orders.customer": orphans("dirty_orders", "o_custkey", "customer", "c_custkey"),
        "dirty_orders.customer_open": orphans(_of("o_orderstatus = 'O'"), "o_custkey", "customer", "c_custkey"),
        "dirty_orders.customer_done": orphans(_of("completed_at IS NOT NULL"), "o_custkey", "customer", "c_custkey"),
        "dirty_orders.known": orphans("dirty_orders", "o_custkey", "dirty_customer", "id"),
        "dirty_orders.supplier": orphans("dirty_orders", "o_custkey", "supplier", "s_suppkey"),
        "dirty_orders.part": orphans("dirty_orders", "o_custkey", "part", "p_partkey"),
        "dirty_orders.user": orphans("dirty_orders", "o_custkey", "events", "user_id"),
        "dirty_orders.once": excess("dirty_orders", "o_custkey"),
        "dirty_orders.once_open": excess(_of("o_orderstatus = 'O'"), "o_custkey"),
        "dirty_orders.once_done": excess(_of("o_orderstatus = 'F'"), "o_custkey"),
    },
)
checks(
    "chk_composite_key",
    **{
        "lineitem.key": LINE_KEY,
        "conversations.key": excess("conversations", "conv_id, turn"),
    },
)


def _ran(rule_id: str, table: str | None, count: str, validated: str, error: str | None) -> str:
    rows = f"(SELECT count(*) FROM {table})" if table else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{rule_id}' AS rule_id, CAST({count} AS BIGINT) AS violations,
  {rows} AS row_count, {validated} AS validated, '{'failed' if error else 'executed'}' AS status,
  {f"'{error}'" if error else 'CAST(NULL AS VARCHAR)'} AS error_class"""


oracle(
    "chk_catalogue",
    union(
        [_ran(c[1], c[0], c[-1], "TRUE", None) for c in CATALOGUE[:5]]
        + [
            _ran("supplier.validity.rating", "supplier", "NULL", "FALSE", "missing_object"),
            _ran("sql.pending", "orders", "(SELECT count(*) FROM orders WHERE o_orderstatus = 'P')",
                 "TRUE", None),
            _ran("sql.text_count", "orders", "(SELECT count(*) FROM orders)", "TRUE", None),
            _ran("sql.no_row", "orders", "0", "TRUE", None),
            _ran("sql.write", "orders", "NULL", "FALSE", "permission"),
            _ran("sql.syntax", "orders", "NULL", "FALSE", "syntax"),
            _ran("sql.column", "orders", "NULL", "FALSE", "missing_object"),
            _ran("run.cast", "events", "NULL", "TRUE", "type_mismatch"),
            _ran("run.value", "events", "(SELECT count(*) FROM events WHERE value > 100)", "TRUE", None),
            _ran("table.missing", None, "NULL", "FALSE", "missing_object"),
            _ran("kind.missing", "orders", "NULL", "FALSE", "missing_object"),
        ]
    ),
)

# ---- verdicts -----------------------------------------------------------------------

chain(
    "judge_rules",
    "SELECT table_name, rule_id, category, violations, threshold_pct, status, passed FROM judged",
)
chain(
    "resume_run",
    "SELECT table_name, rule_id, category, violations, threshold_pct, status, passed FROM judged",
)
chain(
    "assess_approx",
    "SELECT table_name, rule_id, category, violations, threshold_pct, status, passed FROM judged",
)
chain("verdict_counts", "SELECT table_name, n_rules, dq_pass, dq_fail, unchecked FROM states")
chain("category_scores", "SELECT table_name, category, ok, total, score FROM scored")
chain("suggestions", "SELECT table_name, part, suggestion FROM advice")
_SCORE = one_decimal("dq_pass / n_rules * 100.0")
chain(
    "table_scores",
    f"""SELECT table_name, n_rules, dq_pass, dq_fail, {_SCORE} AS score_log,
  {_SCORE} AS score_report FROM states""",
)
_OVERALL = f"""SELECT CAST(sum(n_rules) AS BIGINT) AS n_rules, CAST(sum(dq_pass) AS BIGINT) AS dq_pass,
  CAST(sum(dq_fail) AS BIGINT) AS dq_fail,
  {one_decimal('sum(dq_pass) / (sum(dq_pass) + sum(dq_fail)) * 100.0')} AS score_governance,
  {one_decimal('sum(dq_pass) / sum(n_rules) * 100.0')} AS score_report FROM states"""
chain("overall_scores", _OVERALL)
_CELL = "max(score) FILTER (category = '{0}') AS {1}"
chain(
    "table_reviews",
    """SELECT table_name, TRUE AS profile_ok, dq_pass, dq_fail, """
    + ", ".join(f"score_{c}" for c in SCORED)
    + """, COALESCE(suggestions, '') AS suggestions, 0 AS waived_items
FROM states JOIN (SELECT table_name, """
    + ", ".join(_CELL.format(c, f"score_{c}") for c in SCORED)
    + """ FROM scored GROUP BY table_name) USING (table_name)
LEFT JOIN listed USING (table_name) WHERE stage = 'reviewed'""",
)
oracle(
    "waivers",
    """SELECT table_name, status, count(*) AS n FROM check_log_v c WHERE NOT EXISTS (
  SELECT 1 FROM waived_v w WHERE w.table_name = c.table_name AND w.sql_id = c.sql_id)
GROUP BY table_name, status""",
)

# ---- gates ----------------------------------------------------------------------------

oracle(
    "gate_g1",
    f"""SELECT 'G1' AS gate_id, 'open' AS state,
  'Connected; {len(TABLES)} tables found in schema ''main''' AS reason,
  count(DISTINCT table_name) AS tables FROM described""",
    _DESCRIBED,
)


def gate_log(waived: bool, log: str = "check_log_v", waivers: str = "waived_v") -> str:
    flag = "w.sql_id IS NOT NULL" if waived else "FALSE"
    join = (
        f"LEFT JOIN {waivers} w ON w.table_name = c.table_name AND w.sql_id = c.sql_id"
        if waived
        else ""
    )
    n_waived = (
        f"(SELECT count(*) FROM {waivers} w WHERE w.table_name = l.table_name)" if waived else "0"
    )
    rule = "rule_id" if log == "check_log_fine_v" else "sql_id"
    return f"""logged AS (
SELECT c.*, {flag} AS waived,
  c.status NOT IN ('validated', 'executed') AND NOT {flag} AS pending,
  c.status <> 'executed' AND NOT {flag} AS bad
FROM {log} c {join}),
numbered AS (
SELECT *, row_number() OVER (PARTITION BY table_name, bad ORDER BY sql_id) AS bad_rn,
  row_number() OVER (PARTITION BY table_name, status ORDER BY {rule}) AS status_rn
FROM logged),
tallies AS (
SELECT table_name, count(*) AS n, count(*) FILTER (pending) AS n_pending,
  count(*) FILTER (bad) AS n_bad, {n_waived} AS n_waived,
  string_agg(sql_id, ', ' ORDER BY sql_id) FILTER (pending AND status = 'failed') AS pending_ids,
  string_agg(sql_id, ', ' ORDER BY sql_id) FILTER (bad AND bad_rn <= 5) AS bad_ids,
  string_agg({rule}, ', ' ORDER BY {rule}) FILTER (status = 'failed' AND status_rn <= 5) AS failed_ids,
  count(*) FILTER (status = 'executed') AS n_executed,
  count(*) FILTER (status = 'validated') AS n_validated,
  count(*) FILTER (status = 'failed') AS n_failed
FROM numbered l GROUP BY table_name)"""


def _validated_gate(gate_id: str, label: str) -> str:
    return f"""SELECT '{gate_id}' AS gate_id, table_name,
  CASE WHEN n_pending = 0 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN n_pending = 0 THEN concat('{label}: all ', CAST(n AS VARCHAR), ' SQLs for ''',
    table_name, ''' validated', CASE WHEN n_waived > 0 THEN
    concat(' (', CAST(n_waived AS VARCHAR), ' waived)') ELSE '' END)
  ELSE concat('{label}: ', CAST(n_pending AS VARCHAR), ' of ', CAST(n AS VARCHAR), ' SQLs for ''',
    table_name, ''' not validated', COALESCE(concat('; unfixable after retries: ', pending_ids), '')) END AS reason,
  n_executed, n_validated, n_failed FROM tallies"""


_G3 = """SELECT 'G3' AS gate_id, table_name,
  CASE WHEN n_bad = 0 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN n_bad = 0 THEN concat('Profiling complete for ''', table_name, ''' (',
    CAST(n AS VARCHAR), ' results) - DQ generation unlocked')
  ELSE concat('Profiling incomplete for ''', table_name, ''': ', CAST(n_bad AS VARCHAR),
    ' SQL(s) not executed (', bad_ids, CASE WHEN n_bad > 5 THEN '...' ELSE '' END,
    ') - DQ rule generation stays locked') END AS reason,
  n_executed, n_validated, n_failed FROM tallies"""
_FINE = gate_log(False, "check_log_fine_v")
oracle("gate_g2", _validated_gate("G2", "Profile execution"), _FINE)
oracle("gate_g3", _G3, gate_log(False))
oracle(
    "gate_g4_waived",
    _validated_gate("G4", "DQ execution") + "\nUNION ALL\n" + _G3,
    gate_log(True, "check_log_fine_v", "waived_fine_v"),
)
oracle("gate_g2_wide", _validated_gate("G2", "Profile execution"), gate_log(False))
oracle("gate_g4_wide", _validated_gate("G4", "DQ execution"), gate_log(True))
oracle(
    "gate_failed_parts",
    """SELECT 'G2' AS gate_id, table_name, part, count(*) AS n_ids, string_agg(sql_id, ', ' ORDER BY sql_id) AS names
FROM (SELECT table_name, sql_id, (row_number() OVER (PARTITION BY table_name ORDER BY sql_id) - 1) // 100 + 1 AS part
      FROM check_log_v WHERE status = 'failed') GROUP BY table_name, part""",
)
oracle(
    "gate_g5",
    """SELECT 'G5' AS gate_id, table_name,
  CASE WHEN n_failed <= 1 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN n_failed <= 1
    THEN concat('''', table_name, ''': all DQ checks resolved - review unlocked')
  ELSE concat('''', table_name, ''': ', CAST(n_failed AS VARCHAR),
    ' DQ check(s) unresolved after 3 fix attempts (', failed_ids, ') - review blocked') END AS reason,
  n_executed, n_validated, n_failed FROM tallies""",
    _FINE,
)
_LOG_STATES = """logged_states AS (
SELECT table_name, CASE WHEN n_pending > 0 THEN 'G2' WHEN n_bad > 0 THEN 'G3'
  WHEN n_failed > 0 THEN 'G5' END AS blocked_at FROM tallies)"""
oracle(
    "table_stage",
    """SELECT table_name, CASE WHEN blocked_at IS NULL THEN 'reviewed' ELSE 'blocked' END AS stage,
  blocked_at FROM logged_states""",
    gate_log(False),
    _LOG_STATES,
)
oracle(
    "gate_g6",
    """SELECT 'G6' AS gate_id, CASE WHEN pending = 0 THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN pending = 0 THEN concat('All ', CAST(tables AS VARCHAR), ' tables reviewed - full report unlocked')
  ELSE concat('Final report gate: ', CAST(pending AS VARCHAR), ' table(s) not reviewed (', names,
    ') - report generated in PARTIAL mode') END AS reason, tables, pending
FROM (SELECT count(*) AS tables, count(blocked_at) AS pending,
  string_agg(table_name, ', ' ORDER BY table_name) FILTER (blocked_at IS NOT NULL) AS names
  FROM logged_states)""",
    gate_log(False),
    _LOG_STATES,
)
chain(
    "report_mode",
    """SELECT CASE WHEN count(*) FILTER (stage = 'blocked') = 0 THEN 'COMPLETE' ELSE 'PARTIAL RUN' END AS mode,
  concat('Final report gate: ', CAST(count(*) FILTER (stage = 'blocked') AS VARCHAR),
    ' table(s) not reviewed (', string_agg(table_name, ', ' ORDER BY table_name)
    FILTER (stage = 'blocked'), ') - report generated in PARTIAL mode') AS reason
FROM states""",
)
oracle(
    "gate_evidence",
    """SELECT 'G2' AS gate_id, table_name, status, sql_id, FALSE AS waived FROM check_log_fine_v
UNION ALL
SELECT 'G4', c.table_name, c.status, c.sql_id, w.sql_id IS NOT NULL
FROM check_log_fine_v c LEFT JOIN waived_fine_v w ON w.table_name = c.table_name AND w.sql_id = c.sql_id""",
)
_CHANGED = """changed AS (
SELECT event_id, ts, gate_id, state FROM (SELECT *, lag(state) OVER (
  PARTITION BY gate_id ORDER BY ts, event_id) AS before FROM audit_v)
WHERE before IS DISTINCT FROM state)"""
oracle("gate_changes", "SELECT event_id, ts, gate_id, state FROM changed", _CHANGED)
oracle(
    "gate_timeline",
    """SELECT ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, gate_id, upper(state) AS state
FROM changed""",
    _CHANGED,
)

# ---- event and statement logs -----------------------------------------------------------

oracle(
    "lint_sql_log",
    r"""SELECT sql_id, CASE
  WHEN NOT regexp_matches(sql_text, '(?i)^\s*(select|with|explain)\b') THEN 'bad_start'
  WHEN regexp_matches(regexp_replace(sql_text, '''(?:''''|[^''])*''|/\*[\s\S]*?\*/|--[^\r\n]*', '''''', 'g'),
    '(?i)\b(drop|delete|update|insert|alter|create|truncate|attach|grant|revoke|merge|replace|vacuum)\b')
    THEN 'ddl_dml'
  WHEN contains(rtrim(regexp_replace(sql_text, '\s+$', ''), ';'), ';') THEN 'multi'
  ELSE 'ok' END AS verdict
FROM sql_log_v""",
)
oracle(
    "classify_errors",
    """SELECT event_id, CASE
  WHEN m LIKE '%syntax%' OR m LIKE '%near "%' OR m LIKE '%unrecognized token%' THEN 'syntax'
  WHEN m LIKE '%no such table%' OR m LIKE '%no such column%' OR m LIKE '%does not exist%'
    OR m LIKE '%not found%' THEN 'missing_object'
  WHEN m LIKE '%type%' AND (m LIKE '%mismatch%' OR m LIKE '%invalid%') THEN 'type_mismatch'
  WHEN m LIKE '%denied%' OR m LIKE '%permission%' OR m LIKE '%read-only%' THEN 'permission'
  WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' OR m LIKE '%canceled%' THEN 'timeout'
  ELSE 'unknown' END AS error_class
FROM (SELECT event_id, lower(COALESCE(message, '')) AS m FROM error_log_v)""",
)
oracle(
    "payload_digests",
    """SELECT event_id, substr(sha256(concat('{"event_type": ', CAST(to_json(event_type) AS VARCHAR),
  ', "props": ', CAST(to_json(CAST(props AS VARCHAR)) AS VARCHAR), ', "user_id": ',
  CAST(user_id AS VARCHAR), '}')), 1, 12) AS digest FROM events""",
)
oracle(
    "event_outcomes",
    "SELECT kind, outcome, count(*) AS n FROM audit_v GROUP BY kind, outcome",
)
oracle(
    "agent_activity",
    """SELECT agent, calls, CAST(least(floor(calls / max(calls) OVER () * 100), 100) AS INTEGER) AS bar_pct
FROM (SELECT agent, count(*) AS calls FROM audit_v GROUP BY agent)""",
)
oracle(
    "call_latency",
    """SELECT agent, outcome, count(*) AS calls, printf('%.1f', avg(ms)) AS avg_ms, max(ms) AS max_ms,
  quantile_disc(ms, 0.95) AS p95_ms
FROM (SELECT agent, outcome, CAST(regexp_extract(detail, 'duration_ms=([0-9]+)', 1) AS BIGINT) AS ms
  FROM audit_v) GROUP BY agent, outcome""",
)

# ---- reports ------------------------------------------------------------------------------

chain(
    "kpis",
    f"""SELECT (SELECT count(*) FROM states) AS tables,
  (SELECT CAST(sum(row_count) AS BIGINT) FROM states) AS total_rows,
  (SELECT (SELECT count(*) FROM states) + 2 * count(*) + count(*) FILTER (dtype IN ('int', 'bigint', 'double'))
   FROM profile) AS profile_items,
  n_rules AS rules, dq_pass AS passed, dq_fail AS failed, score_report AS overall_score,
  (SELECT count(*) FROM audit_v WHERE kind = 'hook') AS hook_events,
  (SELECT count(*) FROM audit_v WHERE kind = 'hook' AND outcome = 'retried') AS retried
FROM ({_OVERALL})""",
)
_LISTED = union(f"SELECT {i} AS pos, '{c}' AS category" for i, c in enumerate(SCORED, 1))
_MEAN = f"""SELECT category, {one_decimal('avg(score)')} AS mean_score, count(*) AS tables
FROM scored GROUP BY category"""
chain(
    "category_averages",
    f"""SELECT pos, category, COALESCE(tables, 0) AS tables, mean_score,
  COALESCE(mean_score, 0.0) AS page_score
FROM ({_LISTED}) LEFT JOIN ({_MEAN}) USING (category)""",
)
_CELLS = ", ".join(_CELL.format(c, c) for c in SCORED)
_MEANS = ", ".join(
    f"(SELECT {one_decimal('avg(score)')} FROM scored WHERE category = '{c}') AS {c}" for c in SCORED
)
chain(
    "scorecard",
    f"""SELECT 0 AS part, table_name, stage, row_count, n_rules, dq_pass, dq_fail,
  {', '.join(SCORED)}, {_SCORE} AS score
FROM states LEFT JOIN (SELECT table_name, {_CELLS} FROM scored GROUP BY table_name) USING (table_name)
UNION ALL
SELECT 1, 'SCHEMA AGGREGATE', concat(CAST(count(*) AS VARCHAR), ' Tables'),
  CAST(sum(row_count) AS BIGINT), CAST(sum(n_rules) AS BIGINT), CAST(sum(dq_pass) AS BIGINT),
  CAST(sum(dq_fail) AS BIGINT), {_MEANS}, {one_decimal('sum(dq_pass) / sum(n_rules) * 100.0')}
FROM states""",
)
_BAND = "CASE WHEN score >= {0} THEN 'ok' WHEN score >= {1} THEN 'warn' ELSE 'bad' END"
chain(
    "score_bands",
    f"""SELECT table_name, score, {_BAND.format(95, 75)} AS matrix_band,
  {_BAND.format(90, 70)} AS card_band FROM (SELECT table_name, {_SCORE} AS score FROM states)""",
)
chain(
    "health_cards",
    f"""SELECT table_name, CASE WHEN dq_fail > 0 THEN concat(CAST(dq_fail AS VARCHAR), ' Violations')
  WHEN stage = 'reviewed' THEN '100% Healthy' ELSE stage END AS badge,
  format('{{:,}}', row_count) AS rows, n_rules, dq_pass, dq_fail, score,
  {_BAND.format(90, 70)} AS band, COALESCE(first_four, '') AS suggestions
FROM (SELECT *, {_SCORE} AS score FROM states) LEFT JOIN listed USING (table_name)""",
)
_STATUS = "CASE WHEN passed THEN 'PASS' WHEN NOT passed THEN 'FAIL' ELSE 'UNCHECKED' END"
_RULE_LOG = f"""SELECT table_name, rule_seq, rule_id, category, COALESCE(column_name, '*') AS column_name,
  description, threshold_pct, violations, {_STATUS} AS status, CASE check_kind
  WHEN 'completeness' THEN concat('SELECT COUNT(*) FROM `', table_name, '` WHERE `', column_name, '` IS NULL')
  WHEN 'email' THEN concat('SELECT COUNT(*) FROM `', table_name, '` WHERE `', column_name, '` NOT LIKE ''%_@_%._%''')
  WHEN 'non_negative' THEN concat('SELECT COUNT(*) FROM `', table_name, '` WHERE `', column_name, '` < 0')
  WHEN 'uniqueness' THEN concat('SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM `', table_name,
    '` GROUP BY `', column_name, '`) AS g')
  WHEN 'non_empty' THEN concat('SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM `', table_name, '`')
  ELSE check_kind END AS check_sql FROM judged"""
chain("rule_log", _RULE_LOG)
chain(
    "rule_search",
    f"""SELECT 'text' AS search, rule_id, status FROM ({_RULE_LOG}) WHERE status = 'FAIL' AND contains(
  lower(concat(table_name, ' ', column_name, ' ', rule_id, ' ', category, ' ', description)), 'unique')
UNION ALL SELECT 'category', rule_id, status FROM ({_RULE_LOG}) WHERE category = 'validity'
UNION ALL SELECT 'table', rule_id, status FROM ({_RULE_LOG}) WHERE status = 'PASS'
  AND table_name = 'orders' AND contains(
  lower(concat(table_name, ' ', column_name, ' ', rule_id, ' ', category, ' ', description)), 'o_')""",
)
_MARKDOWN = "replace(replace({0}, chr(10), ' '), '|', '\\|')"
oracle(
    "check_repairs",
    f"""SELECT table_name, sql_id, COALESCE(error_class, 'unknown') AS error_class, attempts,
  CASE WHEN status = 'executed' THEN 'REPAIRED' ELSE 'FAILED' END AS status,
  {_MARKDOWN.format('COALESCE(first_text, sql_text)')} AS original_sql,
  {_MARKDOWN.format('sql_text')} AS final_sql,
  substr({_MARKDOWN.format("COALESCE(last_error, '')")}, 1, 80) AS last_error
FROM repair_log_v WHERE first_text IS NOT NULL OR status = 'failed'""",
)
_NUMBERED = """SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY part, seq)
  AS INTEGER) AS pos, suggestion FROM advice WHERE table_name <> 'supplier'"""
chain("recommendations", _NUMBERED)
chain("priority_actions", f"SELECT * FROM ({_NUMBERED}) ORDER BY table_name, pos LIMIT 8")
chain(
    "governance_summary",
    f"""SELECT (SELECT count(*) FROM states) AS tables,
  (SELECT count(*) FROM states WHERE stage = 'reviewed') AS reviewed,
  (SELECT count(*) FROM states WHERE stage = 'blocked') AS blocked,
  dq_pass, dq_fail, score_governance AS overall_score, dq_fail = 0 AS zero_defects
FROM ({_OVERALL})""",
)
chain(
    "run_summary",
    """SELECT table_name, stage, CASE WHEN stage = 'blocked' THEN 'DQ pending' ELSE concat('DQ ',
  CAST(dq_pass AS VARCHAR), '/', CAST(dq_pass + dq_fail AS VARCHAR), ' pass') END AS dq,
  CASE WHEN stage = 'blocked' THEN 'G2=open, G3=open, G4=closed'
       ELSE 'G2=open, G3=open, G4=open, G5=open' END AS gates
FROM states""",
)

# ---- stored runs and logs -------------------------------------------------------------------

oracle(
    "audit_read",
    """SELECT kind, outcome, count(*) AS n, count(*) AS dated FROM (
SELECT kind, outcome FROM audit_v WHERE kind <> 'note' AND outcome <> 'error'
UNION ALL SELECT kind, outcome FROM audit_v WHERE outcome = 'retried')
GROUP BY kind, outcome""",
)
_CHECK_ID = """CASE check_kind WHEN 'non_empty' THEN concat('dq.', table_name, '.non_empty')
  WHEN 'completeness' THEN concat('dq.', table_name, '.null.', column_name)
  WHEN 'uniqueness' THEN concat('dq.', table_name, '.dup.', column_name)
  WHEN 'email' THEN concat('dq.', table_name, '.email.', column_name)
  WHEN 'non_negative' THEN concat('dq.', table_name, '.nonneg.', column_name)
  ELSE concat('dq.', rule_id) END"""
_ENTITIES = f"""SELECT 'manifest' AS entity, table_name, concat_ws('|', CAST(ordinal AS VARCHAR), column_name, dtype) AS content
FROM profile
UNION ALL SELECT 'table_states', table_name, concat_ws('|', stage, CASE WHEN stage = 'blocked' THEN 'G4' END) FROM states
UNION ALL SELECT 'gates', table_name, concat(g, '|', CASE WHEN g = 'G4' AND stage = 'blocked' THEN 'closed' ELSE 'open' END)
FROM states, (VALUES ('G2'), ('G3'), ('G4'), ('G5')) AS gate(g) WHERE stage = 'reviewed' OR g < 'G5'
UNION ALL SELECT 'check_log', table_name, concat_ws('|', {_CHECK_ID}, status) FROM judged
UNION ALL SELECT 'column_profile', table_name, concat_ws('|', column_name, CAST(row_count AS VARCHAR),
  CAST(null_count AS VARCHAR), CAST(distinct_count AS VARCHAR)) FROM profile
UNION ALL SELECT 'rule_results', table_name, concat_ws('|', rule_id, CAST(violations AS VARCHAR), status,
  CAST(passed AS VARCHAR)) FROM judged
UNION ALL SELECT 'reviews', table_name, concat_ws('|', CAST(dq_pass AS VARCHAR), CAST(dq_fail AS VARCHAR))
FROM states WHERE stage = 'reviewed'"""
chain("run_roundtrip", _ENTITIES)
chain(
    "fork_run",
    f"""SELECT entity, table_name, CASE WHEN entity = 'table_states' AND table_name = 'orders'
  THEN 'discovery' ELSE content END AS content
FROM ({_ENTITIES}) WHERE table_name <> 'orders' OR entity IN ('manifest', 'table_states')""",
)
chain(
    "pending",
    """SELECT table_name, (SELECT count(*) FROM states WHERE stage = 'blocked') AS pending,
  (SELECT count(*) FROM states WHERE stage = 'reviewed') AS skipped
FROM states WHERE stage <> 'reviewed'""",
)
chain(
    "report_write",
    f"""SELECT 'rule_log' AS section, table_name, concat_ws('|', rule_id, CAST(violations AS VARCHAR), {_STATUS})
  AS content FROM judged
UNION ALL SELECT 'scorecard', table_name, table_name FROM states
UNION ALL SELECT 'scorecard', 'SCHEMA AGGREGATE', 'SCHEMA AGGREGATE'""",
)

# ---- streams ----------------------------------------------------------------------------------

oracle(
    "stream_audit_counts",
    "SELECT agent, outcome, count(*) AS n FROM audit_v GROUP BY agent, outcome",
)
oracle("stream_gate_changes", "SELECT event_id, ts, gate_id, state FROM changed", _CHANGED)
oracle("stream_gate_feed", "SELECT event_id, ts, gate_id, state, CAST(1 AS BIGINT) AS n FROM changed", _CHANGED)
_STREAMED = {
    "events.value": "value < 10 OR value > 90",
    "events.type": "event_type NOT IN ('click', 'view', 'purchase')",
    "events.late": "ts > TIMESTAMP '2024-01-20 00:00:00'",
    "events.user": "user_id IS NULL",
}
oracle(
    "stream_rules",
    union(
        f"""SELECT '{r}' AS rule_id, count(*) AS row_count, count(*) FILTER ({c}) AS violations
FROM events"""
        for r, c in _STREAMED.items()
    ),
)
oracle(
    "stream_windows",
    union(
        f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, '{r}' AS rule_id,
  count(*) AS row_count, count(*) FILTER ({c}) AS violations FROM events GROUP BY 1"""
        for r, c in _STREAMED.items()
    ),
)

# ---- flagship -----------------------------------------------------------------------------------

oracle(
    "flagship",
    f"""SELECT table_name, rule_id, category, violations, row_count, passed,
  {one_decimal('(count(*) FILTER (passed) OVER (PARTITION BY category)) / count(*) OVER (PARTITION BY category) * 100.0')}
    AS category_score,
  {one_decimal('(count(*) FILTER (passed) OVER ()) / count(*) OVER () * 100.0')} AS table_score
FROM (SELECT *, violations <= row_count * (100.0 - threshold_pct) / 100.0 AS passed FROM derived)""",
    profile_cte(["orders"]),
    DERIVED,
)

_GROWN = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "", "o_orderpriority": "t"}


def _grown(column: str, kind: str) -> str:
    blank = f"CAST(count_if(trim({column}) = '') AS BIGINT)" if kind == "t" else "CAST(NULL AS BIGINT)"
    low, high = (f"CAST({f}({column}) AS DOUBLE)" if kind == "n" else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
    return f"""SELECT '{column}' AS column_name, count(*) AS row_count, count(*) - count({column}) AS null_count,
  {blank} AS blank_count, {low} AS min_num, {high} AS max_num, TRUE AS distinct_within,
  CAST(1 AS BIGINT) AS parts_read FROM orders"""


oracle("profile_increments", union(_grown(c, k) for c, k in _GROWN.items()))
