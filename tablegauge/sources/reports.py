"""Report datasets as files."""

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_report(frames: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Write each report section to a folder of its own; returns the folders."""
    written = []
    for name, df in frames.items():
        target = f"{path}/{name}"
        df.write.mode("overwrite").format(fmt).save(target)
        written.append(target)
    return written
