"""Structured Streaming forms. The row logic is the batch operators', unchanged."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codeharbor.operators import agentlog, extraction
from codeharbor.plans import analysis
from codeharbor.plans.skew import few_broadcast
from codeharbor.sources.files import _plain_path
from codeharbor.sources.sinks import append_batch, is_folder, latest, read_versions, upsert_table


def file_stream(spark: SparkSession, root: str, glob: str = "*", per_trigger: int = 10_000) -> DataFrame:
    """files(path, content, n_bytes, modified_at) as new files arrive."""
    text = (
        spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
        .text(root, wholetext=True, pathGlobFilter=glob)
    )
    return text.select(
        _plain_path().alias("path"),
        F.col("value").alias("content"),
        F.col("_metadata.file_size").alias("n_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def table_stream(spark: SparkSession, root: str, glob: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive: the files that `glob` names, or those of the folder of that name."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    table = f"{root.rstrip('/')}/{glob}"
    if is_folder(spark, table):  # its files have names of their own, which the filter would drop
        return rows.parquet(table)
    return rows.option("pathGlobFilter", glob).parquet(root)


def analyze_stream(files: DataFrame) -> DataFrame:
    """The one-pass analysis of each new file: stateless, append."""
    return analysis.analyze(files)


def table_refs_stream(files: DataFrame) -> DataFrame:
    return extraction.table_refs(files)


def turns_stream(messages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Turn roll-up without state: each micro-batch adds its partial totals to a table of versions.

    A turn may stay open for any time and its messages may come late; nothing is kept between the
    batches. `read_turns` merges the partial totals, and `done` says whether the result message came.
    """
    return versions_stream(messages, table, checkpoint, agentlog.turn_partials)


def read_turns(spark: SparkSession, table: str) -> DataFrame:
    return agentlog.merge_turns(read_versions(spark, table))


def session_gaps_stream(calls: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Closed call sessions, append mode."""
    window = F.session_window("ts", gap)
    return (
        calls.withWatermark("ts", lateness).groupBy("session_id", window).agg(F.count("*").alias("n_calls"))
        .select("session_id", F.col("session_window.start").alias("session_start"),
                F.col("session_window.end").alias("session_end"), "n_calls")
    )


def rate_breaches_stream(
    calls: DataFrame, limit: Column, width: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """Windows over the limit, append mode: each is told once, when it can no longer change."""
    return agentlog.rate_breaches(calls.withWatermark("ts", lateness), limit, width)


def without_repeats(rows: DataFrame, keys: list[str], ts: str = "ts", bound: str = "10 minutes") -> DataFrame:
    """The first row of every key; a repeat at most `bound` later in event time is dropped.

    State holds the keys of that span only, whatever the length of the stream.
    """
    return rows.withWatermark(ts, bound).dropDuplicatesWithinWatermark(keys)


def ruled_breaches_stream(
    calls: DataFrame, rules: str, default: int, table: str, checkpoint: str, width: str = "1 minute", lateness: str = "10 minutes"
) -> StreamingQuery:
    """Windows over the limit of their tool, by a table of rules(tool_name, limit) at a path.

    The rules are read anew for every micro-batch, so a changed limit holds from the next batch on, and
    broadcast only if they are few. Tools without a rule have the default. Rows go to a table of versions.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        limits = latest(spark.read.parquet(rules).select("tool_name", "limit"), ["tool_name"], ["limit"])
        limits = few_broadcast(limits)
        told = batch.join(limits, "tool_name", "left").withColumn("limit", F.coalesce(F.col("limit").cast("long"), F.lit(default).cast("long")))
        append_batch(told.filter("n_calls > limit"), table.rstrip("/"), f"{query_id(spark, checkpoint)}-{number}")

    windows = agentlog.calls_per_window(calls.withWatermark("ts", lateness), width)
    return windows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, exactly once, until the input now present is used up."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: another checkpoint, another id."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def versions_stream(
    rows: DataFrame, table: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> StreamingQuery:
    """Append what `each` makes of every micro-batch to a table of versions, exactly once."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        append_batch(each(batch), table.rstrip("/"), f"{query_id(spark, checkpoint)}-{number}")

    return (
        rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_stream(
    rows: DataFrame, table: str, keys: list[str], order: list[str], checkpoint: str,
    repeats: tuple[list[str], str, str] | None = None,
) -> StreamingQuery:
    """Keep the latest row per key in a table; a repeated micro-batch changes nothing.

    `repeats` are (columns, event time, bound) of rows that may be delivered again: of these only the
    first is written, see `without_repeats`.
    """
    if repeats:
        rows = without_repeats(rows, *repeats)

    def apply(batch: DataFrame, number: int) -> None:
        upsert_table(batch, table, keys, order, f"{query_id(batch.sparkSession, checkpoint)}-{number}")

    return (
        rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
