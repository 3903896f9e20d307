"""Views over the given tables, written once for Spark and DuckDB.

The given tables have no NULLs, blanks, orphans or duplicate keys; these views
plant such defects by a fixed rule and keep every row.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
)

VIEWS = {
    "dirty_customer": """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'not-an-email'
       ELSE concat(lower(replace(c_name, '#', '.')), '@example.com') END AS email,
  CASE WHEN c_custkey % 50 = 0 THEN '  ' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 100 = 1 THEN 'SKU-DUP' WHEN c_custkey % 100 = 2 THEN NULL
       ELSE concat('SKU-', CAST(c_custkey AS STRING)) END AS sku,
  c_acctbal AS total_amount
FROM {customer}""",
    "dirty_orders": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1000000
       WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus, o_orderdate,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 13 <> 0
       THEN o_orderdate + INTERVAL 3 DAY END AS completed_at
FROM {orders}""",
    "check_log_v": """
SELECT concat('t', CAST(user_id % 8 AS STRING)) AS table_name,
  concat('q', CAST(event_id AS STRING)) AS sql_id,
  CASE WHEN event_type = 'error' AND user_id % 8 >= 4 THEN 'failed'
       WHEN event_type = 'view' AND user_id % 8 = 2 THEN 'validated'
       ELSE 'executed' END AS status
FROM {events}""",
    # The same statements under one table name a user, so that lists of them stay short.
    "check_log_fine_v": """
SELECT concat('t', CAST(user_id AS STRING)) AS table_name,
  concat('q', CAST(event_id AS STRING)) AS sql_id,
  concat('r', CAST(event_id AS STRING)) AS rule_id,
  CASE WHEN event_type = 'error' AND user_id % 8 >= 4 THEN 'failed'
       WHEN event_type = 'view' AND user_id % 8 = 2 THEN 'validated'
       WHEN event_type = 'signup' AND user_id % 8 = 5 THEN 'generated'
       ELSE 'executed' END AS status
FROM {events}""",
    "waived_fine_v": """
SELECT concat('t', CAST(user_id AS STRING)) AS table_name,
  concat('q', CAST(event_id AS STRING)) AS sql_id
FROM {events} WHERE event_type = 'view' OR event_id % 3 = 0""",
    "waived_v": """
SELECT concat('t', CAST(user_id % 8 AS STRING)) AS table_name,
  concat('q', CAST(event_id AS STRING)) AS sql_id
FROM {events} WHERE event_type = 'view'""",
    "audit_v": """
SELECT event_id, ts, concat('agent', CAST(user_id % 6 AS STRING)) AS agent,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'allowed'
       WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'retried' ELSE 'blocked' END AS outcome,
  CASE event_type WHEN 'view' THEN 'gate' WHEN 'purchase' THEN 'note' ELSE 'hook' END AS kind,
  concat('G', CAST(1 + user_id % 6 AS STRING)) AS gate_id,
  CASE WHEN value < 100 THEN 'open' ELSE 'closed' END AS state,
  concat('duration_ms=', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS detail
FROM {events}""",
    # Statement texts: one form per remainder, and whole documents as literals.
    "sql_log_v": """
SELECT concat('e', CAST(event_id AS STRING)) AS sql_id,
  CASE event_id % 10
    WHEN 0 THEN concat('SELECT count(*) FROM ', event_type)
    WHEN 1 THEN concat('select ''drop ', event_type, ''' from t')
    WHEN 2 THEN concat('SELECT ', CAST(user_id AS STRING), '; DELETE FROM t')
    WHEN 3 THEN concat('DROP TABLE ', event_type)
    WHEN 4 THEN concat('-- ', event_type, '\nSELECT 1')
    WHEN 5 THEN 'SELECT '';'' AS semicolon'
    WHEN 6 THEN concat('SELECT replace(props, ''k'', ''', event_type, ''') FROM t')
    WHEN 7 THEN concat('explain select ', CAST(user_id AS STRING), ' /* drop it */')
    WHEN 8 THEN concat('  With x AS (SELECT 1) SELECT ', CAST(user_id AS STRING), ';; ')
    ELSE props END AS sql_text
FROM {events}
UNION ALL
SELECT concat('d', CAST(doc_id AS STRING)) AS sql_id,
  CASE WHEN doc_id % 3 = 0 THEN text
       ELSE concat('SELECT * FROM d WHERE body = ''', replace(text, '''', ''''''), '''') END
    AS sql_text
FROM {documents}""",
    "error_log_v": """
SELECT event_id,
  CASE event_id % 12
    WHEN 0 THEN concat('near "', event_type, '": syntax error')
    WHEN 1 THEN concat('no such table: ', event_type)
    WHEN 2 THEN concat('column "', event_type, '" DOES NOT EXIST')
    WHEN 3 THEN 'Type mismatch: cannot compare'
    WHEN 4 THEN concat('invalid input syntax for type ', event_type)
    WHEN 5 THEN concat('permission DENIED for relation ', event_type)
    WHEN 6 THEN 'statement timed out'
    WHEN 7 THEN 'query canceled, timeout not found'
    WHEN 8 THEN 'invalid value of type integer'
    WHEN 9 THEN concat('attempt to write a read-only database ', event_type)
    WHEN 10 THEN NULL
    ELSE props END AS message
FROM {events}""",
    "result_log_v": """
SELECT event_id,
  CASE event_id % 8
    WHEN 0 THEN concat('  ', CAST(user_id AS STRING), '.9 ')
    WHEN 1 THEN event_type
    WHEN 2 THEN NULL
    WHEN 3 THEN concat('-', CAST(user_id AS STRING))
    WHEN 4 THEN concat(CAST(user_id % 10 AS STRING), 'e3')
    WHEN 5 THEN ''
    WHEN 6 THEN concat(CAST(user_id AS STRING), 'd')
    ELSE props END AS result
FROM {events}""",
    "repair_log_v": """
SELECT concat('t', CAST(user_id % 8 AS STRING)) AS table_name,
  concat('q', CAST(event_id AS STRING)) AS sql_id,
  concat('SELECT `', event_type, '` | ', CAST(user_id AS STRING), '\nFROM t') AS sql_text,
  CASE WHEN event_type IN ('click', 'error')
       THEN concat('SELECT ', event_type, ' | ', CAST(user_id AS STRING), '\nFROM t') END AS first_text,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'executed' END AS status,
  CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN 3 ELSE 0 END AS attempts,
  CASE WHEN event_type IN ('click', 'error')
       THEN concat('near "', event_type, '": syntax error | while reading ', props, ' from the log of user ',
                   CAST(user_id AS STRING), ' and all of its other entries') END AS last_error,
  CASE WHEN event_type = 'click' THEN 'syntax' END AS error_class
FROM {events}""",
}


_opened: dict[tuple[str, int, str], DataFrame] = {}


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its footers are read once per session, its rows each time."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _opened:
        _opened[key] = spark.read.parquet(path)
    return _opened[key]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name not in VIEWS:
        return given(spark, folder, name)
    text = VIEWS[name]
    used = {t: given(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def views(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: view(spark, folder, name) for name in names}
