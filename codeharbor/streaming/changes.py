"""Analysis kept up to date over files that change: versions by content hash, withdrawals, folder syncs.

A table of this kind is three tables of versions below one folder. `state` has a row per path and
version (hash, gone or not), `analysis` and `refs` have what each version says. A version that replaces
another withdraws what the older one said: reading joins to the latest state, so nothing is rewritten.
Files whose content did not change are not analysed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeharbor.operators import extraction
from codeharbor.plans import analysis
from codeharbor.sources.files import _plain_path, read_files
from codeharbor.sources.sinks import append_batch, committed, latest, read_versions
from codeharbor.streaming.streams import query_id

STATE = "path string, version long, digest string, gone boolean"


def _state(spark: SparkSession, table: str) -> DataFrame:
    """The state rows so far; none before the first batch."""
    if not committed(spark, f"{table}/state"):
        return spark.createDataFrame([], STATE)
    return read_versions(spark, f"{table}/state").select("path", "version", "digest", "gone")


def current(spark: SparkSession, table: str) -> DataFrame:
    """(path, version, digest, gone): the latest state of every path."""
    return latest(_state(spark, table), ["path"], ["version"])


def apply_changes(versions: DataFrame, table: str, batch: str, feature_limit: int | None = None) -> None:
    """Take in versions(path, version, content): of each path the greatest version; null content: gone.

    A version not above the one that stands, or with the same content, changes nothing. What versions
    say is committed before their state, so no reader sees a version without its rows; a batch that is
    repeated under its name changes nothing.
    """
    table = table.rstrip("/")
    if batch in committed(versions.sparkSession, f"{table}/state"):
        return
    content = F.col("content")
    new = latest(versions.select("path", "version", "content"), ["path"], ["version"])
    new = new.withColumn("digest", F.sha2(content.cast("binary"), 256)).withColumn("gone", content.isNull())
    known = current(versions.sparkSession, table).select("path", F.col("version").alias("had"), F.col("digest").alias("was"), F.col("gone").alias("left"))
    new = new.join(known, "path", "left").filter(
        (F.col("had").isNull() | (F.col("version") > F.col("had")))
        & ~F.when(F.col("gone"), F.coalesce(F.col("left"), F.lit(True))).otherwise(F.col("digest").eqNullSafe(F.col("was")))
    )
    new = new.select("path", "version", "content", "digest", "gone").persist()  # read three times; a lost part is made again
    changed = new.filter("NOT gone").select("path", "version", "content")
    append_batch(_analysed(changed, feature_limit), f"{table}/analysis", batch)
    append_batch(_references(changed), f"{table}/refs", batch)
    append_batch(new.select("path", "version", "digest", "gone"), f"{table}/state", batch)
    new.unpersist()


def _with_version(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("path", "version"), "path")


def _analysed(files: DataFrame, feature_limit: int | None) -> DataFrame:
    return _with_version(analysis.analyze(files, feature_limit=feature_limit), files)


def _references(files: DataFrame) -> DataFrame:
    return _with_version(extraction.table_refs(files), files)


def _current_only(spark: SparkSession, table: str, part: str) -> DataFrame:
    alive = current(spark, table).filter("NOT gone").select("path", "version")
    return read_versions(spark, f"{table}/{part}").join(alive, ["path", "version"], "left_semi")


def read_analysis(spark: SparkSession, table: str) -> DataFrame:
    """The analysis of every file there is, with the version it is of."""
    return _current_only(spark, table.rstrip("/"), "analysis")


def read_refs(spark: SparkSession, table: str) -> DataFrame:
    """The table references of every file there is."""
    return _current_only(spark, table.rstrip("/"), "refs").drop("version")


def ref_history(spark: SparkSession, table: str) -> DataFrame:
    """Every reference ever told: (path, direction, table_name, n_parts, version, withdrawn).

    `withdrawn` is the version that replaced the reference's own, or took the file away; null: it stands.
    Only narrow state rows are put in order, as many per path as the path has versions.
    """
    table = table.rstrip("/")
    following = F.lead("version").over(Window.partitionBy("path").orderBy("version"))
    spans = _state(spark, table).withColumn("withdrawn", following).select("path", "version", "withdrawn")
    return read_versions(spark, f"{table}/refs").join(spans, ["path", "version"])


def changes_stream(versions: DataFrame, table: str, checkpoint: str, feature_limit: int | None = None) -> StreamingQuery:
    """Apply every micro-batch of a stream of versions(path, version, content), exactly once."""

    def apply(batch: DataFrame, number: int) -> None:
        apply_changes(batch, table, f"{query_id(batch.sparkSession, checkpoint)}-{number}", feature_limit)

    return versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_changes(spark: SparkSession, root: str, glob: str, table: str) -> DataFrame:
    """versions(path, version, content) of a folder against what the table holds.

    The version is the modification time in microseconds. Files are listed without their contents; then
    only files from the oldest changed one on are read, which the scan prunes by their time. Files that
    are listed no more are gone, one past their last version.
    """
    known = current(spark, table.rstrip("/")).filter("NOT gone").select("path", "version")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    listing = listing.select(_plain_path("path").alias("path"), F.col("modificationTime").alias("modified_at"))
    changed = listing.join(known, (listing.path == known.path) & (F.unix_micros("modified_at") == known.version), "left_anti")
    since = changed.agg(F.min("modified_at")).first()[0]
    files = read_files(spark, root, glob)
    files = files.filter(F.lit(False) if since is None else F.col("modified_at") >= F.lit(since))
    fresh = files.join(changed.select("path"), "path", "left_semi").select("path", F.unix_micros("modified_at").alias("version"), "content")
    gone = known.join(listing.select("path"), "path", "left_anti")
    return fresh.unionByName(gone.select("path", (F.col("version") + 1).alias("version"), F.lit(None).cast("string").alias("content")))


def sync_folder(spark: SparkSession, root: str, glob: str, table: str, batch: str) -> None:
    """Bring the table up to date with a folder: new, rewritten and removed files. `batch` names the run."""
    apply_changes(folder_changes(spark, root, glob, table), table, batch)
