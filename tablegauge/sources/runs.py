"""Stored runs: entities in versioned folders, and a commit record that names the valid ones.

A save writes every entity to a folder of its own and the record last, as one small file,
so a run is read as it was before a save or as it is after it, never in between. A fork
that changes nothing is only a record.
"""

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegauge.sources.storage import remove, subfolders

# Entities of a run. Those in RESET are emptied for a table that starts over.
ENTITIES = (
    "manifest",
    "table_states",
    "gates",
    "check_log",
    "column_profile",
    "rule_results",
    "reviews",
    "waivers",
)
RESET = frozenset(ENTITIES) - {"manifest", "table_states"}
#: Commit records, and the versions they name, that stay: the newest, and the one before it for readers that have begun.
KEPT = 2
RECORD = "version STRING, entity STRING, path STRING"


class NoSuchRun(ValueError):
    """A run was never committed, or has no such entity."""


def _named(run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r}: use letters, digits, '_', '.' and '-'")
    return f"run_id={run_id}"


def _records(spark: SparkSession, root: str) -> DataFrame | None:
    """Commit records `(run_id, seq, version, entity, path)` of all runs."""
    try:
        return spark.read.schema(RECORD + ", run_id STRING, seq BIGINT").json(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _committed(spark: SparkSession, run_id: str, root: str) -> tuple[int, dict[str, str]]:
    """Number and paths of a run's newest record: a row per entity reaches the driver."""
    found = _records(spark, root)
    if found is None:
        return 0, {}
    own = found.where(F.col("run_id") == run_id)
    # Two writers may have taken the same number; one of them, as a whole, is the newest.
    newest = own.agg(F.max(F.struct("seq", "version")).alias("last")).first().last
    if newest is None:
        return 0, {}
    rows = own.where((F.col("seq") == newest.seq) & (F.col("version") == newest.version)).collect()
    return newest.seq, {r.entity: r.path for r in rows}


def _commit(spark: SparkSession, run_id: str, root: str, paths: Mapping[str, str], seq: int, version: str) -> None:
    rows = [(version, entity, path) for entity, path in sorted(paths.items())]
    record = spark.createDataFrame(rows, RECORD).coalesce(1)
    record.write.mode("append").json(f"{root}/commits/{_named(run_id)}/seq={seq}")


def _superseded(spark: SparkSession, run_id: str, root: str, seq: int) -> list[str]:
    """Paths of one of a run's old records that no run's kept records name."""
    records = _records(spark, root)
    age = F.dense_rank().over(W.partitionBy("run_id").orderBy(F.desc("seq")))
    valid = records.withColumn("age", age).where(F.col("age") <= KEPT).select("path")
    old = records.where((F.col("run_id") == run_id) & (F.col("seq") == seq)).select("path").distinct()
    return [r.path for r in old.join(valid, "path", "left_anti").collect()]


def save_run(run_id: str, entities: Mapping[str, DataFrame], root: str) -> None:
    """Write entities of a run and commit them together; its other entities stay as they were.

    If anything fails before the end, the run is what it was. Versions that no kept record
    of any run names any more are deleted after the commit.
    """
    folder = _named(run_id)
    unknown = set(entities) - set(ENTITIES)
    if unknown:
        raise ValueError(f"unknown run entities: {sorted(unknown)}")
    if not entities:
        return
    spark = next(iter(entities.values())).sparkSession
    seq, paths = _committed(spark, run_id, root)
    version = uuid.uuid4().hex
    for name, df in entities.items():
        paths[name] = f"{name}/{folder}/version={version}"
        df.write.parquet(f"{root}/{paths[name]}")
    _commit(spark, run_id, root, paths, seq + 1, version)
    _forget(spark, run_id, root, seq + 1 - KEPT)


def _forget(spark: SparkSession, run_id: str, root: str, seq: int) -> None:
    """Delete an old record and what only it names."""
    if seq > 0:
        for path in _superseded(spark, run_id, root, seq):
            remove(spark, f"{root}/{path}")
        remove(spark, f"{root}/commits/{_named(run_id)}/seq={seq}")


def clean_run(spark: SparkSession, run_id: str, root: str) -> list[str]:
    """Delete versions that saves of a run left unfinished; nothing may be saving it meanwhile."""
    folder, records, gone = _named(run_id), _records(spark, root), []
    valid = set()
    if records is not None:
        own = records.where(F.col("path").contains(f"/{folder}/")).select("path").distinct()
        valid = {r.path for r in own.collect()}
    for entity in ENTITIES:
        for version in subfolders(spark, f"{root}/{entity}/{folder}"):
            path = f"{entity}/{folder}/{version}"
            if path not in valid:
                remove(spark, f"{root}/{path}")
                gone.append(path)
    return gone


def load_run(
    spark: SparkSession, run_id: str, root: str, names: tuple[str, ...] = ENTITIES
) -> dict[str, DataFrame]:
    """The entities of a run as of its last complete save."""
    _named(run_id)
    _, paths = _committed(spark, run_id, root)
    missing = [name for name in names if name not in paths]
    if missing:
        raise NoSuchRun(f"run {run_id!r} has no {', '.join(missing)}")
    return {name: spark.read.parquet(f"{root}/{paths[name]}") for name in names}


def reset_table(entities: Mapping[str, DataFrame], table: str) -> dict[str, DataFrame]:
    """Put one table back to discovery, with nothing else recorded for it."""
    out = {}
    for name, df in entities.items():
        if name in RESET:
            df = df.where(~F.col("table_name").eqNullSafe(table))
        elif name == "table_states":
            fresh = F.col("table_name") == table
            df = df.withColumn(
                "stage", F.when(fresh, "discovery").otherwise(F.col("stage"))
            ).withColumn("blocked_at", F.when(~fresh, F.col("blocked_at")))
        out[name] = df
    return out


def fork_run(
    spark: SparkSession,
    run_id: str,
    new_run_id: str,
    root: str,
    *,
    reset: str | None = None,
    names: tuple[str, ...] = ENTITIES,
) -> dict[str, DataFrame]:
    """A run under a new id, starting one table over if asked.

    Entities that stay as they are belong to both runs and are not copied; either run
    may be saved again without a change to the other.
    """
    if new_run_id == run_id:
        raise ValueError("a fork needs a run id of its own")
    folder = _named(new_run_id)
    entities = load_run(spark, run_id, root, names)
    _, given = _committed(spark, run_id, root)
    seq, _ = _committed(spark, new_run_id, root)
    paths, version = {name: given[name] for name in names}, uuid.uuid4().hex
    if reset is not None:
        for name, df in reset_table(entities, reset).items():
            if name in RESET or name == "table_states":
                paths[name] = f"{name}/{folder}/version={version}"
                df.write.parquet(f"{root}/{paths[name]}")
    _commit(spark, new_run_id, root, paths, seq + 1, version)
    _forget(spark, new_run_id, root, seq + 1 - KEPT)
    return load_run(spark, new_run_id, root, names)
