"""A whole assessment: profile, rules, verdicts, gates and reports."""

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tablegauge.operators import gates as G
from tablegauge.operators.checks import brief, error_class_of, run_rules
from tablegauge.operators.profile import (
    SKETCH_ERROR,
    exact_where_close,
    profile_statements,
    profile_table,
)
from tablegauge.operators.rules import check_sql, derive_and_settle, statement_id
from tablegauge.operators.verdict import judge, reviews
from tablegauge.schemas import CHECK_LOG, COLUMN_PROFILE, WAIVERS
from tablegauge.sources.runs import save_run
from tablegauge.sources.storage import run_folder, settle
from tablegauge.sources.tables import Tables, discover, pending_tables

#: Tables profiled at the same time.
PARALLEL_TABLES = 8


@dataclass
class Assessment:
    """The frames of one run, each one row per table, column, rule or statement."""

    manifest: DataFrame
    column_profile: DataFrame
    judged: DataFrame
    check_log: DataFrame
    gates: DataFrame
    final_gate: DataFrame
    table_states: DataFrame
    reviews: DataFrame
    waivers: DataFrame

    def entities(self) -> dict[str, DataFrame]:
        return {
            "manifest": self.manifest,
            "table_states": self.table_states,
            "gates": self.gates,
            "check_log": self.check_log,
            "column_profile": self.column_profile,
            "rule_results": self.judged,
            "reviews": self.reviews,
            "waivers": self.waivers,
        }

    def save(self, run_id: str, root: str) -> None:
        save_run(run_id, self.entities(), root)


def rule_statements(results: DataFrame) -> DataFrame:
    """Rule checks as log rows."""
    return results.select(
        "table_name",
        statement_id().alias("sql_id"),
        F.lit("dq_check").alias("purpose"),
        "column_name",
        check_sql().alias("sql_text"),
        "status",
        F.when(F.col("status") == "failed", 1).otherwise(0).alias("attempts"),
        "last_error",
        "error_class",
        F.array().cast("array<string>").alias("fix_history"),
    ).select(*CHECK_LOG.fieldNames())


def table_gates(
    profile_items: DataFrame,
    results: DataFrame,
    waivers: DataFrame | None = None,
    max_unresolved: int = 0,
) -> DataFrame:
    """Gates G2 to G5 of every table.

    Statements pass G2 and rule checks pass G4 once they resolve; G3 and G5 look
    at how they ran. The statements of a profile all resolve.
    """
    at_g4 = rule_statements(
        results.withColumn(
            "status", F.when(F.col("validated"), "validated").otherwise(F.col("status"))
        )
    )
    resolved = F.when(F.col("status") == "failed", "validated").otherwise(F.col("status"))
    at_g2 = profile_items.withColumn("status", resolved)
    return G.all_gates(
        G.gate_profile_execution(at_g2, waivers),
        G.gate_rule_generation(profile_items, waivers),
        G.gate_rule_execution(at_g4, waivers),
        G.gate_review(results.select("table_name", "rule_id", "status"), max_unresolved),
    )


def settle_profiles(
    spark: SparkSession,
    tables: Tables,
    not_null: Mapping[str, Iterable[str]],
    options: Mapping[str, object],
) -> tuple[DataFrame, dict[str, PySparkException]]:
    """Stored profiles, and the tables that could not be read.

    Every table is a job of its own, a few at a time, so plans stay small and a
    table that fails costs no other table a second look.

    With `mode="approx"` a sketch cannot tell a key from a near-key. Columns whose
    sketch lies within its error of the rows, and columns with a key's name, are
    counted exactly in a second look at those columns alone.
    """
    root, errors = run_folder(spark, "profiles"), {}

    def work(place_and_name: tuple[int, str]) -> str | None:
        place, name = place_and_name
        path = f"{root}/{place}"
        try:
            found = profile_table(tables[name], name, not_null=not_null.get(name, ()), **options)
            if options.get("mode") == "approx":
                found = exact_where_close(
                    tables[name], settle(found), float(options.get("rsd", SKETCH_ERROR))
                )
            found.write.parquet(path)
        except PySparkException as error:
            errors[name] = error
            return None
        return path

    with ThreadPoolExecutor(max_workers=PARALLEL_TABLES) as pool:
        done = pool.map(inheritable_thread_target(spark)(work), enumerate(sorted(tables)))
        paths = [path for path in done if path]
    if not paths:
        return spark.createDataFrame([], COLUMN_PROFILE), errors
    return spark.read.schema(COLUMN_PROFILE).parquet(*paths), errors


def profile_log(
    spark: SparkSession, manifest: DataFrame, broken: Mapping[str, PySparkException]
) -> DataFrame:
    """Profile statements with their outcome; those of a broken table failed."""
    items = profile_statements(manifest)
    if not broken:
        return items
    errors = spark.createDataFrame(
        [(name, brief(e), error_class_of(e)) for name, e in broken.items()],
        "table_name STRING, brief STRING, class STRING",
    )
    hit = F.col("class").isNotNull()
    return (
        items.join(errors, "table_name", "left")
        .withColumns(
            {
                "status": F.when(hit, "failed").otherwise(F.col("status")),
                "attempts": F.when(hit, 1).otherwise(F.col("attempts")),
                "last_error": F.col("brief"),
                "error_class": F.col("class"),
            }
        )
        .select(*CHECK_LOG.fieldNames())
    )


def assess(
    spark: SparkSession,
    tables: Tables,
    *,
    schema_name: str = "",
    catalogue: DataFrame | None = None,
    waivers: DataFrame | None = None,
    not_null: Mapping[str, Iterable[str]] | None = None,
    max_unresolved: int = 0,
    lookups: Tables | None = None,
    timeout_s: float | None = None,
    **profile_options: object,
) -> Assessment:
    """Profile the tables, derive and check rules, and judge the results.

    Catalogue rules may also refer to the tables of `lookups`; one that has not ended after
    `timeout_s` seconds counts as failed.

    The tables are read by the profile and by the catalogue rules; everything
    after works on frames with a row per column, rule or statement. The profile
    and the rule results are stored once in the shared folder and reused. A table
    that cannot be read stops at G3; the others go on.
    """
    if not tables:
        raise ValueError(f"no tables discovered in schema '{schema_name}'")
    manifest = discover(spark, tables, schema_name, not_null=not_null)
    profile, broken = settle_profiles(spark, tables, not_null or {}, profile_options)
    results = derive_and_settle(profile)
    if catalogue is not None:
        if broken:
            gone = spark.createDataFrame([(name,) for name in broken], "table_name STRING")
            catalogue = catalogue.join(F.broadcast(gone), "table_name", "left_anti").select(
                *catalogue.columns
            )
        results = results.unionByName(run_rules(spark, {**(lookups or {}), **tables}, catalogue, timeout_s))
    results = settle(judge(results))
    kept = waivers if waivers is not None else spark.createDataFrame([], WAIVERS)
    items = profile_log(spark, manifest, broken)
    decided = table_gates(items, results, kept, max_unresolved)
    states = settle(G.table_stage(decided))
    judged = G.withhold_blocked(results, states)
    reviewed = states.where(F.col("stage") == "reviewed").select("table_name")
    table_reviews = reviews(
        reviewed,
        judged.join(reviewed, "table_name", "left_semi"),
        profile.join(reviewed, "table_name", "left_semi"),
        kept,
    )
    return Assessment(
        manifest=manifest,
        column_profile=profile,
        judged=judged,
        check_log=items.unionByName(rule_statements(judged)),
        gates=G.all_gates(
            G.gate_connection(manifest, schema_name), G.reached_gates(decided, states)
        ),
        final_gate=G.gate_final(states),
        table_states=states,
        reviews=table_reviews,
        waivers=kept,
    )


def resume(
    spark: SparkSession,
    tables: Tables,
    stored: Mapping[str, DataFrame],
    *,
    schema_name: str = "",
    catalogue: DataFrame | None = None,
    **options: object,
) -> Assessment:
    """Finish a stored run: assess the tables it left pending and keep the rest of it.

    `stored` are the entities of the run (`load_run`); its waivers hold unless others are
    given. Results of reviewed tables are taken as they are, so only pending tables are
    read. The overall gates are decided anew. The names of pending tables, one row a
    table, reach the driver.
    """
    options.setdefault("waivers", stored["waivers"])
    manifest = discover(spark, tables, schema_name, not_null=options.get("not_null"))
    left = {r.table_name for r in pending_tables(manifest, stored["table_states"]).collect()}
    todo = {name: tables[name] for name in sorted(left)}
    old = {
        name: df.where(F.col("table_name").isNotNull() & ~F.col("table_name").isin(*left))
        for name, df in stored.items()
    }
    if todo:
        rules = None
        if catalogue is not None:
            rules = catalogue.where(F.col("table_name").isin(*left))
        # Rules may look up tables that are done; only pending ones are profiled.
        new = assess(
            spark, todo, schema_name=schema_name, catalogue=rules, lookups=tables, **options
        ).entities()
        old = {name: df.unionByName(new[name].where("table_name IS NOT NULL")) for name, df in old.items()}
    states = settle(old["table_states"])
    return Assessment(
        manifest=manifest,
        column_profile=old["column_profile"],
        judged=old["rule_results"],
        check_log=old["check_log"],
        gates=G.all_gates(G.gate_connection(manifest, schema_name), old["gates"]),
        final_gate=G.gate_final(states),
        table_states=states,
        reviews=old["reviews"],
        waivers=options["waivers"],
    )
