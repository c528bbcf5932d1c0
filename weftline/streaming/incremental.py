"""Incremental forms of the batch operators on Structured Streaming.

File sources with checkpoints replace last-run files; ``availableNow`` drains
what is there and stops, so a run resumes where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read once per checkpoint."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def block_counts(events: DataFrame, time: str, key: str, weeks: int = 2, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts per key and block of weeks from a Monday (the origin 2019-12-30); blocks close after the watermark."""
    stream = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, f"{7 * weeks} days", f"{7 * weeks} days", "4 days")
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.groupBy(w.alias("w"), key).agg(*aggregates).select(key, F.col("w.start").alias("block_start"), "n", *(["total"] if value else []))


def mentions_in_time(events: DataFrame, mentions: DataFrame, key: str, event_time: str, mention_time: str, within: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Mentions at most ``within`` after their event, as an interval join with watermarks on both sides."""
    e = events.select(F.col(key).alias("_k"), F.col(event_time).alias("_e"))
    if events.isStreaming:
        e = e.withWatermark("_e", late)
    m = mentions.withWatermark(mention_time, late) if mentions.isStreaming else mentions
    inside = (F.col("_k") == F.col(key)) & (F.col(mention_time) >= F.col("_e")) & (F.col(mention_time) <= F.col("_e") + F.expr(f"interval {within}"))
    return m.join(e, inside).drop("_k")


def first_seen_once(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark (an article is taken once)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def resume_into(stream: DataFrame, work: Callable[[DataFrame], DataFrame], keys: Sequence[str], target: str, checkpoint: str, failed: Column | None = None) -> StreamingQuery:
    """Apply ``work`` to rows whose keys the target does not hold yet, and append its rows.

    Rows for which ``failed`` holds do not count as done and are tried again when
    they come again. A batch that is replayed after a crash adds nothing twice:
    what it wrote is found in the target by its key and batch number.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(list(keys))
        try:
            done = spark.read.parquet(target)
            done = done.where(~F.coalesce(failed, F.lit(False))) if failed is not None else done
            fresh = fresh.join(done.select(*keys).distinct(), list(keys), "left_anti")
        except Exception as error:  # the target does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        work(fresh).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to parquet and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_latest(stream: DataFrame, keys: Sequence[str], order: str, target: str, checkpoint: str) -> StreamingQuery:
    """A table with the newest row per key: every batch merges with it into a new version folder, named in a pointer file written last."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        newest = F.max(F.struct(order, F.struct(*df.columns).alias("row"))).alias("m")
        merged = df
        if number > 0 and (old := current_version(spark, target)) is not None:
            merged = spark.read.parquet(f"{target}/version={old}").unionByName(df)
        merged.groupBy(*keys).agg(newest).select("m.row.*").write.mode("overwrite").parquet(f"{target}/version={number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("overwrite").json(f"{target}/_current")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, target: str) -> int | None:
    try:
        return spark.read.schema("version long").json(f"{target}/_current").first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
