"""Violation counts of rules against the tables.

All row predicates and aggregates of a table are counted in one scan. Rules that
group by the same key of a table, and look that key up in other tables, share one
scan and one shuffle. Other rules have a frame of their own, pre-aggregated before
each shuffle.
"""

import re
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tablegauge.functions.numbers import to_long_or
from tablegauge.functions.text import condition_class, group_key_sql, lint_column
from tablegauge.operators.matching import (
    COMPARISONS,
    comparable,
    excess,
    first_of,
    inequality_pairs,
    key_counts,
    same_keys,
    strays,
)
from tablegauge.operators.profile import col, email_miss, ident, union_all
from tablegauge.schemas import RULE_RESULTS, RULES
from tablegauge.sources.tables import Tables, named_views, row_counts

Params = Mapping[str, str]
LIST_SEPARATOR = "|"
PARALLEL_UNITS = 8
# Position under which a fused frame reports the rows of its table.
ROWS = -1


# Row predicates: true for a violating row; NULL and false both pass.
def _allowed_set(column: str, p: Params) -> Column:
    return ~col(column).cast("string").isin(*p["values"].split(LIST_SEPARATOR))


def _range(column: str, p: Params) -> Column:
    outside = F.lit(False)
    if p.get("low") is not None:
        outside = outside | (col(column) < F.expr(p["low"]))
    if p.get("high") is not None:
        outside = outside | (col(column) > F.expr(p["high"]))
    return outside


ROW_CHECKS: dict[str, Callable[[str, Params], Column]] = {
    "completeness": lambda column, p: col(column).isNull(),
    "email": lambda column, p: email_miss(col(column)),
    "non_negative": lambda column, p: col(column) < 0,
    "allowed_set": _allowed_set,
    "range": _range,
    "pattern": lambda column, p: ~col(column).rlike(p["pattern"]),
    "not_blank": lambda column, p: F.trim(col(column)) == "",
    "not_future": lambda column, p: col(column) > F.expr(p["as_of"]),
    "predicate": lambda column, p: F.expr(p["predicate"]),
}

# Aggregates over a whole table that give the violation count themselves.
AGG_CHECKS: dict[str, Callable[[str, Params], Column]] = {
    "non_empty": lambda column, p: (F.count(F.lit(1)) == 0).cast("bigint"),
    "freshness": lambda column, p: F.when(
        F.max(col(column)) < F.expr(p["as_of"]) - F.expr(f"INTERVAL {p['max_lag']}"), 1
    )
    .otherwise(0)
    .cast("bigint"),
    "aggregate": lambda column, p: F.expr(p["aggregate"]).cast("bigint"),
}


def _keys(df: DataFrame, columns: Iterable[str]) -> list[Column]:
    return [
        F.expr(group_key_sql(ident(c), df.schema[c].dataType)).alias(f"k{i}")
        for i, c in enumerate(columns)
    ]


def _rows(tables: Tables, table: str, p: Params) -> DataFrame:
    """The table's rows that a grouping rule is about: all, or those of its `where`."""
    return tables[table].where(p["where"]) if p.get("where") else tables[table]


def duplicate_excess(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each group; NULL keys form groups too."""
    groups = df.groupBy(*_keys(df, columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations")
    )


def unmatched(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-NULL value is no value of the parent column.

    Both sides are reduced to one row per value before they meet, whatever
    share of the rows one value holds; the join then needs no shuffle of its own.
    """
    values = (
        child.where(col(column).isNotNull())
        .groupBy(col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = parent.select(col(parent_column).alias("v")).where("v IS NOT NULL").distinct()
    return values.join(known, "v", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")
    )


def _sigma_range(tables: Tables, table: str, column: str, p: Params) -> DataFrame:
    df, k = tables[table], float(p.get("k", "3"))
    value = col(column).cast("double")
    bounds = df.agg(F.avg(value).alias("m"), (F.stddev_samp(value) * k).alias("w"))
    low, high = bounds.select(F.expr("m - w")).scalar(), bounds.select(F.expr("m + w")).scalar()
    return df.where((value < low) | (value > high)).agg(
        F.count(F.lit(1)).alias("violations")
    )


def _alike(df: DataFrame, key: str, used: str, reduce_first: bool) -> DataFrame:
    """The key and the used columns, each row or each distinct combination with its count."""
    columns = [key, *(u for u in used.split(LIST_SEPARATOR) if u and u != key)]
    kept = df.where(col(key).isNotNull())
    if not reduce_first:
        return kept.select(*(col(c) for c in columns), F.lit(1).cast("bigint").alias("rows_alike"))
    return kept.groupBy(*(col(c) for c in columns)).agg(F.count(F.lit(1)).alias("rows_alike"))


#: A predicate that compares one column of each side.
PLAIN = re.compile(r"\s*([cp])\.`?(\w+)`?\s*(<=|>=|<|>)\s*([cp])\.`?(\w+)`?\s*")
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _inequality(tables: Tables, table: str, column: str, p: Params) -> DataFrame:
    """Pairs of rows of `table` and a parent with equal keys whose values compare as stated.

    `value` and `parent_value` are SQL expressions over the two tables; `where` and
    `parent_where` restrict their rows. Keys and values must be of kindred types.
    """
    child, parent = _rows(tables, table, p), tables[p["parent"]]
    if p.get("parent_where"):
        parent = parent.where(p["parent_where"])
    if p["comparison"] not in COMPARISONS:
        raise ValueError(f"comparison {p['comparison']!r} is none of {', '.join(COMPARISONS)}")
    value, parent_value = F.expr(p["value"]), F.expr(p["parent_value"])
    kinds = [df.select(v.alias("v")).schema["v"].dataType for df, v in ((child, value), (parent, parent_value))]
    keys = [df.schema[k].dataType for df, k in ((child, column), (parent, p["parent_column"]))]
    if not comparable(*kinds) or not same_keys(*keys):
        raise ValueError("inequality: keys or values of the two tables are of unlike types; cast them")
    return inequality_pairs(
        child, column, value, p["comparison"], parent, p["parent_column"], parent_value
    )


def _ranked(tables: Tables, table: str, column: str, p: Params) -> DataFrame | None:
    """A joined predicate that is a plain comparison, counted without a join; else nothing."""
    found = PLAIN.fullmatch(p["predicate"])
    if not found or found[1] == found[4]:
        return None
    mine, theirs, sign = found[2], found[5], found[3]
    if found[1] == "p":
        mine, theirs, sign = theirs, mine, TURNED[sign]
    child, parent = tables[table], tables[p["parent"]]
    names = ((child, column), (parent, p["parent_column"])), ((child, mine), (parent, theirs))
    if any(name not in df.columns for pair in names for df, name in pair):
        return None
    (k, pk), (v, pv) = [[df.schema[name].dataType for df, name in pair] for pair in names]
    if not same_keys(k, pk) or not comparable(v, pv):
        return None
    return inequality_pairs(child, column, col(mine), sign, parent, p["parent_column"], col(theirs))


def _joined_predicate(tables: Tables, table: str, column: str, p: Params) -> DataFrame:
    """Joined rows of `table` (as `c`) and a parent (as `p`) breaking a predicate.

    A predicate that only compares a column of each side, such as `c.x < p.y`, is counted by
    running totals without a join, whatever share of the rows a key holds on both sides.
    Others are joined: `uses` and `parent_uses` name the columns of the predicate besides
    the keys. Each side is shuffled once, by the key, and adaptive execution splits hot
    keys. Where a key repeats on both sides, `reduce` ("child", "parent" or
    "child|parent") counts equal rows of those sides first, so that they meet only
    once per distinct combination, at the price of one more shuffle.
    """
    ranked = _ranked(tables, table, column, p)
    if ranked is not None:
        return ranked
    first = p.get("reduce", "").split(LIST_SEPARATOR)
    child = _alike(tables[table], column, p.get("uses", ""), "child" in first).alias("c")
    parent = _alike(
        tables[p["parent"]], p["parent_column"], p.get("parent_uses", ""), "parent" in first
    ).alias("p")
    met = child.join(parent, F.expr(f"c.`{column}` = p.`{p['parent_column']}`"))
    pairs = F.col("c.rows_alike") * F.col("p.rows_alike")
    return met.where(F.expr(p["predicate"])).agg(
        F.coalesce(F.sum(pairs), F.lit(0)).cast("bigint").alias("violations")
    )


def _statement(tables: Tables, table: str, column: str, p: Params) -> DataFrame:
    """First cell of a statement, read as a count; no row gives 0."""
    text = p["sql_text"]
    spark = next(iter(tables.values())).sparkSession
    with named_views(tables):
        found = spark.sql(text)
    head = found.schema.fields[0]
    return (
        found.toDF(*[f"c{i}" for i in range(len(found.columns))])
        .limit(1)
        .agg(
            F.coalesce(F.max(to_long_or(F.col("c0"), head.dataType, 0)), F.lit(0))
            .cast("bigint")
            .alias("violations")
        )
    )


# Checks that group or join: a one-row frame with the violation count.
FRAME_CHECKS: dict[str, Callable[[Tables, str, str, Params], DataFrame]] = {
    "uniqueness": lambda tables, t, c, p: duplicate_excess(_rows(tables, t, p), [c]),
    "natural_key": lambda tables, t, c, p: duplicate_excess(
        _rows(tables, t, p), p["columns"].split(LIST_SEPARATOR)
    ),
    "orphans": lambda tables, t, c, p: unmatched(
        _rows(tables, t, p), c, tables[p["parent"]], p["parent_column"]
    ),
    "domain_lookup": lambda tables, t, c, p: unmatched(
        _rows(tables, t, p), c, tables[p["lookup"]], p["lookup_column"]
    ),
    "inequality": _inequality,
    "sigma_range": _sigma_range,
    "joined_predicate": _joined_predicate,
    "sql": _statement,
}


class UnknownCheck(ValueError):
    """A rule names a check or a table that does not exist."""


class TimedOut(RuntimeError):
    """A rule ran longer than it may."""


class ReadOnlyViolation(ValueError):
    """A rule's statement is not a single read-only query."""


def error_class_of(error: Exception) -> str:
    if isinstance(error, UnknownCheck):
        return "missing_object"
    if isinstance(error, KeyError):
        return "missing_object"
    if isinstance(error, ReadOnlyViolation):
        return "permission"
    if isinstance(error, TimedOut):
        return "timeout"
    return condition_class(error)


def brief(error: Exception) -> str:
    return str(error).split("\n", 1)[0].strip()


def _count_frame(rule: Row, tables: Tables, lint: str) -> DataFrame:
    """One-row frame for a single rule; building it is the dry run."""
    kind, table, column, p = rule.check_kind, rule.table_name, rule.column_name, rule.params
    if kind != "sql" and table not in tables:
        raise UnknownCheck(f"no table named {table}")
    if kind in ROW_CHECKS:
        hit = ROW_CHECKS[kind](column, p or {})
        return tables[table].agg(F.count_if(hit).alias("violations"))
    if kind in AGG_CHECKS:
        return tables[table].agg(AGG_CHECKS[kind](column, p or {}).alias("violations"))
    if kind not in FRAME_CHECKS:
        raise UnknownCheck(f"no check named {kind}")
    if kind == "sql" and lint != "ok":
        raise ReadOnlyViolation(f"statement refused by the read-only lint: {lint}")
    return FRAME_CHECKS[kind](tables, table, column, p or {})


def _fused_frame(rules: Sequence[tuple[int, Row]], df: DataFrame) -> DataFrame:
    """All row and aggregate checks of a table from one scan, and its row count."""
    aggregates = [F.count(F.lit(1)).alias("v_rows")]
    for i, rule in rules:
        p = rule.params or {}
        if rule.check_kind in ROW_CHECKS:
            hit = F.count_if(ROW_CHECKS[rule.check_kind](rule.column_name, p))
        else:
            hit = AGG_CHECKS[rule.check_kind](rule.column_name, p)
        aggregates.append(hit.cast("bigint").alias(f"v{i}"))
    cells = [f"named_struct('pos', {ROWS}, 'violations', v_rows)"]
    cells += [f"named_struct('pos', {i}, 'violations', v{i})" for i, _ in rules]
    return df.agg(*aggregates).selectExpr(f"inline(array({', '.join(cells)}))")


#: Grouping rules that can share a shuffle, with the parameters that name a parent's table and column.
KEYED: dict[str, tuple[str, str] | None] = {
    "uniqueness": None,
    "natural_key": None,
    "orphans": ("parent", "parent_column"),
    "domain_lookup": ("lookup", "lookup_column"),
}


def _key_columns(rule: Row) -> tuple[str, ...]:
    p = rule.params or {}
    return tuple(p["columns"].split(LIST_SEPARATOR)) if rule.check_kind == "natural_key" else (rule.column_name,)


def _shares_key(rule: Row, tables: Tables) -> bool:
    """Whether the rule groups by a key under which others of the table can be counted too."""
    if rule.check_kind not in KEYED:
        return False
    names, p = KEYED[rule.check_kind], rule.params or {}
    if names is None:
        return True
    key = tables[rule.table_name].schema[rule.column_name].dataType
    return same_keys(key, tables[p[names[0]]].schema[p[names[1]]].dataType)


def _keyed_frame(rules: Sequence[tuple[int, Row]], tables: Tables) -> DataFrame:
    """All grouping rules of one key of a table from one scan and one shuffle, and its row count."""
    table, columns = rules[0][1].table_name, _key_columns(rules[0][1])
    conditions: dict[str, int] = {}
    parents: dict[tuple[str, str], int] = {}
    counts = {}
    for i, rule in rules:
        p, names = rule.params or {}, KEYED[rule.check_kind]
        n = f"n{first_of(conditions, p['where'])}" if p.get("where") else "n"
        if names is None:
            counts[i] = excess(n)
        else:
            counts[i] = strays(n, f"has{first_of(parents, (p[names[0]], p[names[1]]))}")
    found = key_counts(
        tables[table], columns, list(conditions), [(tables[name], column) for name, column in parents]
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("v_rows"),
        *[count.alias(f"v{i}") for i, count in counts.items()],
    )
    cells = [f"named_struct('pos', {ROWS}, 'violations', v_rows)"]
    cells += [f"named_struct('pos', {i}, 'violations', v{i})" for i in counts]
    return found.selectExpr(f"inline(array({', '.join(cells)}))")


def _fusable(rule: Row) -> bool:
    return rule.check_kind in ROW_CHECKS or rule.check_kind in AGG_CHECKS


def lint_statements(spark: SparkSession, texts: Mapping[int, str]) -> dict[int, str]:
    """Lint verdicts of catalogue statements, by their position."""
    if not texts:
        return {}
    listed = spark.createDataFrame(list(texts.items()), "pos INT, sql_text STRING")
    verdicts = listed.select("pos", lint_column(F.col("sql_text")).alias("lint"))
    return {r.pos: r.lint for r in verdicts.collect()}


class _Batch:
    """Rules of a run that passed the dry run, and those that did not.

    The rules are counted in units: all fusable rules of a table together, all grouping
    rules of a table and key together, every other rule by itself.
    """

    def __init__(self, tables: Tables, rules: Sequence[Row], timeout_s: float | None = None):
        self.tables = tables
        self.timeout_s = timeout_s
        self.rules = dict(enumerate(rules))
        self.failed: dict[int, Exception] = {}
        self.frames: dict[int, DataFrame] = {}
        texts = {
            i: (r.params or {}).get("sql_text", "")
            for i, r in self.rules.items()
            if r.check_kind == "sql"
        }
        lint = lint_statements(next(iter(tables.values())).sparkSession, texts)
        for i, rule in self.rules.items():
            try:
                self.frames[i] = _count_frame(rule, tables, lint.get(i, "ok"))
            except (PySparkException, ValueError, KeyError) as error:
                self.failed[i] = error

    def units(self) -> list[list[int]]:
        shared: dict[tuple, list[int]] = {}
        for i in self.frames:
            found = self.rules[i]
            if _fusable(found):
                key = (found.table_name,)
            elif _shares_key(found, self.tables):
                key = (found.table_name, _key_columns(found))
            else:
                key = (i,)
            shared.setdefault(key, []).append(i)
        return list(shared.values())

    def frame(self, unit: Sequence[int]) -> DataFrame:
        """Counts `(pos, violations)` of a unit, and its table's rows if known."""
        first = self.rules[unit[0]]
        listed = [(i, self.rules[i]) for i in unit]
        if _fusable(first):
            return _fused_frame(listed, self.tables[first.table_name])
        if len(unit) > 1:
            return _keyed_frame(listed, self.tables)
        return self.frames[unit[0]].select(F.lit(unit[0]).alias("pos"), "violations")

    def count(self, unit: Sequence[int]) -> dict[int, int]:
        """Count a unit; around a rule that fails or takes too long it is halved."""
        try:
            # One row per rule comes back.
            found = {r.pos: r.violations for r in self.collected(self.frame(unit))}
        except (PySparkException, TimedOut) as error:
            if len(unit) == 1:
                self.failed[unit[0]] = error
                return {}
            middle = len(unit) // 2
            return self.count(unit[:middle]) | self.count(unit[middle:])
        return found

    def collected(self, df: DataFrame) -> list[Row]:
        """The rows of a small frame; its jobs are cancelled when the time is up."""
        if self.timeout_s is None:
            return df.collect()
        context, tag, late = df.sparkSession.sparkContext, f"rules-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout_s, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except (PySparkException, Py4JJavaError):
            if late.is_set():
                raise TimedOut(f"statement timed out after {self.timeout_s:g} s") from None
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def run(self, spark: SparkSession) -> tuple[dict[int, int], dict[str, int]]:
        """Violations per rule and rows per table; units run side by side."""
        units = self.units()
        with ThreadPoolExecutor(max_workers=PARALLEL_UNITS) as pool:
            found = list(pool.map(inheritable_thread_target(spark)(self.count), units))
        sizes, counts = {}, {}
        for unit, numbers in zip(units, found):
            if ROWS in numbers:
                sizes[self.rules[unit[0]].table_name] = numbers.pop(ROWS)
            counts |= numbers
        return counts, sizes


def run_rules(
    spark: SparkSession, tables: Tables, rules: DataFrame, timeout_s: float | None = None
) -> DataFrame:
    """Run every rule and report counts, row counts and failures.

    A rule that does not resolve, fails while running, or has not ended after
    `timeout_s` seconds is marked `failed` with its error class; the others are still
    counted. What comes back to the driver is one number per rule and table.
    """
    rows = rules.select(*RULES.fieldNames()).orderBy("table_name", "rule_seq", "rule_id").collect()
    batch = _Batch(tables, rows, timeout_s)
    counted, sizes = batch.run(spark)
    unknown = {r.table_name for r in rows} & set(tables) - set(sizes)
    if unknown:
        rest = row_counts({t: tables[t] for t in unknown}).collect()
        sizes |= {r.table_name: r.row_count for r in rest}
    results = []
    for i, rule in batch.rules.items():
        error = batch.failed.get(i)
        results.append(
            tuple(rule[n] for n in RULES.fieldNames())
            + (
                counted.get(i),
                sizes.get(rule.table_name),
                i in batch.frames,
                "failed" if error else "executed",
                None,
                error_class_of(error) if error else None,
                brief(error) if error else None,
            )
        )
    return spark.createDataFrame(results, RULE_RESULTS)


def rule_counts(tables: Tables, rules: Sequence[Row]) -> DataFrame:
    """Lazy violation counts `(rule_id, violations)` of rules known to be sound."""
    batch = _Batch(tables, rules)
    for error in batch.failed.values():
        raise error
    names = F.create_map(
        *[x for i, r in batch.rules.items() for x in (F.lit(i), F.lit(r.rule_id))]
    )
    found = union_all(batch.frame(unit) for unit in batch.units())
    return found.where(F.col("pos") != ROWS).select(
        names[F.col("pos")].alias("rule_id"), "violations"
    )


def rule(
    table: str,
    rule_id: str,
    kind: str,
    column: str | None = None,
    *,
    category: str = "validity",
    description: str = "",
    threshold_pct: float = 100.0,
    seq: int = 0,
    **params: str,
) -> Row:
    """A catalogue rule as a row of the rule layout."""
    return Row(*RULES.fieldNames())(
        table, seq, rule_id, column, category, description, kind, params, threshold_pct
    )


def rules_frame(spark: SparkSession, rules: Sequence[Row]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULES)
