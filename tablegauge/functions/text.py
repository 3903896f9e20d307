"""Text helpers for reports, value shapes, query lint and error classes."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First words that the read-only lint accepts, and words that it refuses.
READ_ONLY_STARTS = ("select", "with", "explain")
WRITE_WORDS = (
    "drop",
    "delete",
    "update",
    "insert",
    "alter",
    "create",
    "truncate",
    "attach",
    "grant",
    "revoke",
    "merge",
    "replace",
    "vacuum",
)
# Fragments of error messages by class, in order of precedence.
ERROR_FRAGMENTS = {
    "syntax": ("syntax", 'near "', "unrecognized token"),
    "missing_object": ("no such table", "no such column", "does not exist", "not found"),
    "permission": ("denied", "permission", "read-only"),
    "timeout": ("timeout", "timed out", "canceled"),
}
MISSING = "—"

_START = rf"(?i)^\s*({'|'.join(READ_ONLY_STARTS)})\b"
_WRITE = rf"(?i)\b({'|'.join(WRITE_WORDS)})\b"
# A doubled quote inside a literal reads as two literals side by side, so a
# plain character class is enough and long literals need no backtracking.
_QUOTED, _BLOCK, _LINE = r"'[^']*'", r"/\*(?:[^*]|\*(?!/))*+\*/", r"--.*"
_LITERAL_OR_COMMENT = f"{_QUOTED}|{_BLOCK}|{_LINE}"
_TAIL = r";*\s*$"

# Spark's own error conditions, by prefix.
CONDITION_CLASSES = {
    "PARSE_SYNTAX_ERROR": "syntax",
    "PARSE_EMPTY_STATEMENT": "syntax",
    "TABLE_OR_VIEW_NOT_FOUND": "missing_object",
    "UNRESOLVED_COLUMN": "missing_object",
    "UNRESOLVED_ROUTINE": "missing_object",
    "DATATYPE_MISMATCH": "type_mismatch",
    "CAST_INVALID_INPUT": "type_mismatch",
    "CAST_OVERFLOW": "type_mismatch",
}


def shorten(value: Column, width: int) -> Column:
    """First `width` characters and an ellipsis when there are more."""
    cut = F.concat(F.substring(value, 1, width), F.lit("..."))
    return F.when(F.length(value) > width, cut).otherwise(value)


def table_cell(value: Column) -> Column:
    """Make text safe for a cell of a Markdown table."""
    one_line = F.replace(value, F.lit("\n"), F.lit(" "))
    return F.replace(one_line, F.lit("|"), F.lit("\\|"))


def or_missing(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def log_second(ts: Column) -> Column:
    """Timestamp text to the second, with a blank between date and time."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def value_shape(value: Column) -> Column:
    """Replace digits by 9 and letters by A, keeping everything else."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]", "A")


def lint_column(sql: Column) -> Column:
    """`ok`, `bad_start`, `ddl_dml` or `multi` for each statement text."""
    text = F.coalesce(sql, F.lit(""))
    code = F.regexp_replace(text, _LITERAL_OR_COMMENT, "''")
    return (
        F.when(~text.rlike(_START), "bad_start")
        .when(code.rlike(_WRITE), "ddl_dml")
        .when(F.regexp_replace(text, _TAIL, "").contains(";"), "multi")
        .otherwise("ok")
    )


def _mentions(text: Column, fragments: Sequence[str]) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | text.contains(fragment)
    return found


def classify_error_column(message: Column) -> Column:
    """Error class of each message; the first class that fits wins."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(_mentions(m, ERROR_FRAGMENTS["syntax"]), "syntax")
        .when(_mentions(m, ERROR_FRAGMENTS["missing_object"]), "missing_object")
        .when(m.contains("type") & _mentions(m, ("mismatch", "invalid")), "type_mismatch")
        .when(_mentions(m, ERROR_FRAGMENTS["permission"]), "permission")
        .when(_mentions(m, ERROR_FRAGMENTS["timeout"]), "timeout")
        .otherwise("unknown")
    )


def condition_class(error: Exception) -> str:
    """Error class of an exception raised by Spark."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    for prefix, error_class in CONDITION_CLASSES.items():
        if condition.startswith(prefix) or f"[{prefix}" in str(error):
            return error_class
    return "unknown"


def payload_digest(names: Sequence[str]) -> Column:
    """First 12 hex digits of SHA-256 over the key-sorted JSON of the columns.

    Text, whole numbers, booleans and NULL are spelled `{"a": 1, "b": "x"}`,
    with one blank after each colon and comma.
    """
    parts = []
    for name in sorted(names):
        cell = F.to_json(F.array(F.col(name)))
        body = cell.substr(F.lit(2), F.length(cell) - 2)
        parts.append(F.concat(F.lit(f'"{name}": '), body))
    payload = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return F.substring(F.sha2(payload, 256), 1, 12)


def group_key_sql(value: str, dtype: T.DataType) -> str:
    """Key that groups equal values while shuffling at most 64 bytes of text.

    Text of up to 48 bytes stands for itself; longer text is replaced by its
    SHA-256 in hex, which is 64 bytes long and so never meets a short text. Text of
    another collation than the binary one is equal in more ways than its bytes, and
    groups as it is.
    """
    if not isinstance(dtype, T.StringType) or getattr(dtype, "collation", "UTF8_BINARY") != "UTF8_BINARY":
        return value
    return f"CASE WHEN octet_length({value}) > 48 THEN sha2({value}, 256) ELSE {value} END"
