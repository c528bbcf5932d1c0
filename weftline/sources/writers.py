"""Writers: twins, append logs, versions that are never overwritten while read, run notes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def twins(df: DataFrame, path: str) -> None:
    """The same rows as parquet and CSV; the frame is read back from parquet for the second."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.sparkSession.read.parquet(f"{path}.parquet").write.mode("overwrite").options(header=True, quote='"', escape='"').csv(f"{path}.csv")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet partitioned by columns, rows of a partition together, only its own partitions overwritten."""
    df.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def next_version(df: DataFrame, root: str, version: int) -> str:
    """A new version folder of a table; the input versions stay as they are."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path


def watermark(spark: SparkSession, path: str, value: str | None = None) -> str | None:
    """Read the last-run mark of a control table, or write it if a value is given."""
    if value is not None:
        spark.createDataFrame([(value,)], "mark string").coalesce(1).write.mode("overwrite").json(path)
        return value
    try:
        return spark.read.schema("mark string").json(path).agg(F.max("mark")).first()[0]
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def run_notes(path: str, **notes: object) -> None:
    """Parameters, counts and versions of a run as JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(notes, f, indent=2, sort_keys=True, default=str)
