"""The append-only event log: one JSON object per line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.schemas import AUDIT


def as_audit(events: DataFrame) -> DataFrame:
    """Bring events to the log layout; absent fields become NULL."""
    present = set(events.columns)
    columns = []
    for field in AUDIT.fields:
        if field.name not in present:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        source = events.schema[field.name].dataType.typeName()
        value = F.col(f"`{field.name}`")
        if source in ("map", "struct", "array"):
            value = F.to_json(value)
        columns.append(value.cast(field.dataType).alias(field.name))
    return events.select(*columns)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events; an event without a time is stamped with the job's start."""
    stamped = as_audit(events).withColumn(
        "ts",
        F.coalesce(
            "ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        ),
    )
    stamped.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Read the log, leaving out blank lines and lines that are no JSON object.

    Event times come back as `event_ts`, NULL where the text is no timestamp.
    """
    lines = (
        spark.read.schema(AUDIT)
        .option("mode", "DROPMALFORMED")
        .option("columnNameOfCorruptRecord", "")
        .json(path)
    )
    return lines.withColumn("event_ts", F.try_to_timestamp("ts"))
