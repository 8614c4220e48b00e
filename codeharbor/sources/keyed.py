"""Tables laid out for point lookups: sorted by key, small row groups, statistics and Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 1 << 20


def write_keyed(rows: DataFrame, out: str, key: str, row_group_bytes: int = ROW_GROUP_BYTES, distinct: int | None = None) -> None:
    """Write the rows ranged and sorted by key, so that the statistics of files and row groups tell them
    apart; each row group has a Bloom filter of its keys, which also spares groups whose range holds the key.

    `distinct` is the expected number of keys in a row group, if known.
    """
    writer = (
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.page.write-checksum.enabled", "true")
    )
    if distinct:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", distinct)
    writer.parquet(out)


def keyed(spark: SparkSession, out: str) -> DataFrame:
    """The table; a filter on the key reaches the scan and prunes files' row groups."""
    return spark.read.parquet(out)


def lookup(spark: SparkSession, out: str, key: str, *values) -> DataFrame:
    """The rows with one of the given keys."""
    return keyed(spark, out).filter(F.col(key).isin(*values) if len(values) != 1 else F.col(key) == F.lit(values[0]))
