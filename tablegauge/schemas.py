"""Record layouts and enumerations shared by all operators."""

from pyspark.sql import types as T

# Names users meet in stored runs, rules and event logs.
SQL_STATUS = ("draft", "validated", "executed", "failed", "fixed")
REPORT_CATEGORIES = (
    "completeness",
    "uniqueness",
    "validity",
    "consistency",
    "timeliness",
    "accuracy",
)

TEXT, FLAG, INT, COUNT, REAL = (
    T.StringType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
)
TEXTS = T.ArrayType(TEXT)
OPTIONS = T.MapType(TEXT, TEXT)


def _layout(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


MANIFEST = _layout(
    schema_name=TEXT,
    table_name=TEXT,
    ordinal=INT,
    column_name=TEXT,
    dtype=TEXT,
    nullable=FLAG,
    row_estimate=COUNT,
)

# One row per table and column. `miss_count` and `negative_count` are the
# violation counts of the name-driven validity rules; they are NULL where no
# such rule applies to the column.
COLUMN_PROFILE = _layout(
    table_name=TEXT,
    ordinal=INT,
    column_name=TEXT,
    dtype=TEXT,
    nullable=FLAG,
    row_count=COUNT,
    null_count=COUNT,
    distinct_count=COUNT,
    min_num=REAL,
    max_num=REAL,
    min_str=TEXT,
    max_str=TEXT,
    blank_count=COUNT,
    miss_count=COUNT,
    negative_count=COUNT,
    top_values=T.ArrayType(_layout(value=TEXT, n=COUNT)),
)

RULES = _layout(
    table_name=TEXT,
    rule_seq=INT,
    rule_id=TEXT,
    column_name=TEXT,
    category=TEXT,
    description=TEXT,
    check_kind=TEXT,
    params=OPTIONS,
    threshold_pct=REAL,
)

# `validated` tells a rule that failed while running from one that never resolved.
RULE_RESULTS = T.StructType(
    RULES.fields
    + _layout(
        violations=COUNT,
        row_count=COUNT,
        validated=FLAG,
        status=TEXT,
        passed=FLAG,
        error_class=TEXT,
        last_error=TEXT,
    ).fields
)

CHECK_LOG = _layout(
    table_name=TEXT,
    sql_id=TEXT,
    purpose=TEXT,
    column_name=TEXT,
    sql_text=TEXT,
    status=TEXT,
    attempts=INT,
    last_error=TEXT,
    error_class=TEXT,
    fix_history=TEXTS,
)

WAIVERS = _layout(table_name=TEXT, sql_id=TEXT)

GATE_LOG = _layout(
    gate_id=TEXT,
    table_name=TEXT,
    state=TEXT,
    reason=TEXT,
    evidence=T.MapType(TEXT, COUNT),
)

# The event log keeps `ts` and `evidence` as the text found in the line, so
# that a line is never lost because one of its values has an unusual form.
AUDIT = _layout(
    kind=TEXT,
    ts=TEXT,
    agent=TEXT,
    hook=TEXT,
    tool=TEXT,
    outcome=TEXT,
    detail=TEXT,
    table=TEXT,
    payload_digest=TEXT,
    gate_id=TEXT,
    state=TEXT,
    reason=TEXT,
    evidence=TEXT,
)

# Lines of the user's catalogues.
METRIC_LINE = _layout(
    table_name=TEXT,
    sql_id=TEXT,
    purpose=TEXT,
    column=TEXT,
    expr=TEXT,
    sql_text=TEXT,
    sql=TEXT,
)
RULE_LINE = _layout(
    table_name=TEXT,
    rule_id=TEXT,
    category=TEXT,
    column=TEXT,
    description=TEXT,
    threshold_pct=REAL,
    check_kind=TEXT,
    params=OPTIONS,
    check_sql=TEXT,
)

METRIC_RESULTS = _layout(
    table_name=TEXT,
    sql_id=TEXT,
    purpose=TEXT,
    column_name=TEXT,
    seq=INT,
    status=TEXT,
    cells=TEXTS,
    error_class=TEXT,
    last_error=TEXT,
)
