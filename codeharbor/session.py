"""Session set-up shared by the entry points, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings, applied only where the session leaves them unset.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Source files are wide rows: bound an Arrow batch by bytes, not only by row count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Session windows merge inside each map task first, so a hot session shuffles few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "codeharbor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to a session someone else made, never overriding a set value."""
    explicit = {row.key for row in spark.sql("SET").collect()}
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, else a folder in the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
