"""Live event counts and rule checks over streams.

Every micro-batch writes to a partition of its own, so a batch that runs again
after a failure replaces what it wrote before.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablegauge.operators.checks import ROW_CHECKS
from tablegauge.operators.gates import gate_changes
from tablegauge.schemas import AUDIT
from tablegauge.sources.storage import remove

Trigger = Mapping[str, object]
#: Default trigger: what is there now, then stop. `{"processingTime": "10 seconds"}` goes on.
ONCE: Trigger = {"availableNow": True}
#: Micro-batches whose state stays: the newest, and the one before it for readers that have begun.
KEPT = 2


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file of a folder or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    files = spark.read.schema(schema).parquet(path).inputFiles()
    reader = spark.readStream.schema(schema)
    if not all(file.endswith(f"/{name}.parquet") for file in files):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_audit(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """The event log as a stream of lines."""
    return (
        spark.readStream.schema(AUDIT)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def live_activity(events: DataFrame) -> DataFrame:
    """Running counts per agent and outcome; the state has one row per pair."""
    return events.groupBy("agent", "outcome").agg(F.count(F.lit(1)).alias("n"))


def write_running_counts(
    counts: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Write the complete counts after each micro-batch, keeping the newest two."""
    return _write_batches(counts, "complete", path, checkpoint, trigger, keep=2)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts as of the last micro-batch."""
    found = spark.read.parquet(path)
    last = found.agg(F.max("batch_id")).scalar()
    return found.where(F.col("batch_id") == last).drop("batch_id")


def _write_batches(
    df: DataFrame,
    mode: str,
    path: str,
    checkpoint: str,
    trigger: Trigger | None = None,
    keep: int | None = None,
) -> StreamingQuery:
    """Write each micro-batch; with `keep`, older batches are emptied once they are superseded."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if keep is not None and batch_id >= keep:
            # The one before the newest stays for readers that have just begun.
            batch.limit(0).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id - keep}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .foreachBatch(replace)
        .start()
    )


def _horizon(rows: DataFrame, time: str, lateness: str | None) -> object | None:
    """The newest time less the lateness, one value; nothing if no decision has a time."""
    if lateness is None:
        return None
    return rows.select(F.expr(f"max(`{time}`) - {lateness}").alias("h")).first().h


def write_gate_changes(
    decisions: DataFrame,
    path: str,
    checkpoint: str,
    *,
    compare: tuple[str, ...] = ("state", "reason"),
    order: tuple[str, ...] = ("ts",),
    lateness: str | None = None,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Keep the decisions that change their gate up to date, in whatever order decisions arrive.

    Decisions are placed by `order`, not by arrival. A late one may be a change itself, and
    may make the decision after it one or no longer one, so decisions stay open and are
    judged anew until they are older than the newest by more than `lateness`, an SQL
    expression such as `INTERVAL 2 DAYS` that is subtracted from the first column of
    `order`. Then they are settled, and of each gate only the last one is kept to compare
    the next with. What arrives later still is set aside (`late_decisions`). Without
    `lateness` every decision stays open: exact for any order of arrival, with a state as
    large as the log. Decisions without a time stay open too.

    A micro-batch reads what the one before left open and writes folders of its own, so
    one that runs again replaces its output; what older ones left is deleted.
    """
    names = decisions.columns

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, part: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{part}/batch_id={batch_id}")

        def older(limit: object | None) -> Column:
            return F.lit(False) if limit is None else F.coalesce(F.col(order[0]) < F.lit(limit), F.lit(False))

        # Read the batch from its source once; lost blocks are read again.
        fresh = batch.withColumn("anchor", F.lit(False)).persist()
        before, shown = fresh.limit(0), batch.limit(0)
        if batch_id > 0:
            before = spark.read.schema(fresh.schema).parquet(f"{path}/open/batch_id={batch_id - 1}")
            shown = spark.read.schema(batch.schema).parquet(f"{path}/current/batch_id={batch_id - 1}")
        missed = older(_horizon(before.where("NOT anchor"), order[0], lateness))
        put(fresh.where(missed).select(names), "late")
        # An anchor, its gate's last settled decision, is older than all that is open.
        seen = before.unionByName(fresh.where(~missed))
        done = older(_horizon(seen.where("NOT anchor"), order[0], lateness))
        judged = gate_changes(seen, compare=compare, order=order, folder=f"{path}/cut")
        changes = judged.where("NOT anchor").select(names).persist()
        put(changes.exceptAll(shown).withColumn("change", F.lit("insert")).unionByName(
            shown.exceptAll(changes).withColumn("change", F.lit("retract"))
        ), "feed")
        put(changes.where(done), "settled")
        newest = F.max_by(F.struct(*names), F.struct(*order)).alias("d")
        anchors = seen.where(done | F.col("anchor")).groupBy("gate_id").agg(newest).select("d.*")
        put(seen.where(~done & ~F.col("anchor")).unionByName(anchors.withColumn("anchor", F.lit(True))), "open")
        # Written last: readers take what is settled up to the newest batch found here.
        put(changes.where(~done), "current")
        changes.unpersist()
        fresh.unpersist()
        for part in ("open", "current"):
            remove(spark, f"{path}/{part}/batch_id={batch_id - KEPT}")

    return (
        decisions.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .foreachBatch(check)
        .start()
    )


def read_gate_changes(spark: SparkSession, path: str) -> DataFrame:
    """The gate changes as of the last micro-batch: what is settled, and what is open as it stands."""
    current = spark.read.parquet(f"{path}/current")
    last = current.agg(F.max("batch_id")).scalar()
    settled = spark.read.parquet(f"{path}/settled").where(F.col("batch_id") <= last)
    return settled.unionByName(current.where(F.col("batch_id") == last)).drop("batch_id")


def gate_change_feed(spark: SparkSession, path: str) -> DataFrame:
    """Every change as it was found or taken back: `change` is insert or retract, `batch_id` tells when."""
    return spark.read.parquet(f"{path}/feed")


def late_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions that arrived after their time was settled; they are in no change."""
    return spark.read.parquet(f"{path}/late").drop("batch_id")


def _hit(rule: Row) -> Column:
    return ROW_CHECKS[rule.check_kind](rule.column_name, rule.params or {})


def _counts(rules: Sequence[Row]) -> list[Column]:
    return [F.count_if(_hit(r)).alias(f"v{i}") for i, r in enumerate(rules)]


def _unpivot(counted: DataFrame, keys: Sequence[str], rules: Sequence[Row]) -> DataFrame:
    cells = [
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"v{i}").alias("violations"))
        for i, r in enumerate(rules)
    ]
    return counted.select(*keys, "row_count", F.inline(F.array(*cells)))


def _row_rules(rules: Sequence[Row]) -> list[Row]:
    odd = [r.rule_id for r in rules if r.check_kind not in ROW_CHECKS]
    if odd:
        raise ValueError(f"only row rules run over a stream: {odd}")
    return list(rules)


def write_batch_violations(
    stream: DataFrame,
    rules: Sequence[Row],
    path: str,
    checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Violation counts of row rules for each micro-batch, in one pass over it."""
    sound = _row_rules(rules)

    def check(batch: DataFrame, batch_id: int) -> None:
        counted = batch.agg(F.count(F.lit(1)).alias("row_count"), *_counts(sound))
        found = _unpivot(counted, (), sound)
        found.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .foreachBatch(check)
        .start()
    )


def _instant(stream: DataFrame, name: str) -> Column:
    """Event time as an instant; a time without a zone is taken as UTC."""
    if isinstance(stream.schema[name].dataType, T.TimestampNTZType):
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name))
        return local.cast("timestamp")
    return F.col(name).cast("timestamp")


def windowed_violations(
    stream: DataFrame, rules: Sequence[Row], ts: str, width: str, lateness: str
) -> DataFrame:
    """Violation counts of row rules per time window of event time.

    Windows close once the watermark passes them, which bounds the state to the
    windows still open.
    """
    sound = _row_rules(rules)
    counted = (
        stream.withColumn("event_time", _instant(stream, ts))
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("row_count"), *_counts(sound))
        .withColumn("window_start", F.col("w.start"))
    )
    return _unpivot(counted, ("window_start",), sound)


def write_windows(
    windows: DataFrame, path: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Write the windows that each micro-batch changed."""
    return _write_batches(windows, "update", path, checkpoint, trigger)


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last count written for each window and rule."""
    found = spark.read.parquet(path)
    return found.groupBy("window_start", "rule_id").agg(
        F.max_by("row_count", "batch_id").alias("row_count"),
        F.max_by("violations", "batch_id").alias("violations"),
    )


def batch_totals(spark: SparkSession, path: str) -> DataFrame:
    """Violations per rule over all micro-batches."""
    return (
        spark.read.parquet(path)
        .groupBy("rule_id")
        .agg(
            F.sum("row_count").alias("row_count"),
            F.sum("violations").alias("violations"),
        )
    )
