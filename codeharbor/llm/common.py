"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 24 * 1024 * 1024


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def scratch(spark: SparkSession) -> str:
    """A new folder name below the folder that the cluster shares.

    Only where none is set, as in a test on one machine, a temporary folder stands in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="llm-")
    return f"{shared}/llm-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, whatever executor is lost."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fresh_name(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, in any case of letters."""
    taken = {c.lower() for c in frame.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def total_bytes(frame: DataFrame, column: str) -> int:
    return frame.agg(F.sum(F.octet_length(column))).first()[0] or 0


def block_count(frame: DataFrame, column: str) -> int:
    """Blocks of about BLOCK_BYTES of text each, in proportion to the input."""
    return total_bytes(frame, column) // BLOCK_BYTES + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges(a, b): the smallest node reachable, by alternating star contraction.

    Each round turns the neighbours of a node towards the smallest of them; rounds grow with the
    logarithm of the longest path. Edges live in tables of the shared folder between rounds.
    """
    links = written(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    seen = None
    while True:
        both = links.union(links.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a", "least(a, low) AS low")
        large = both.join(least, "a").filter("b > a").selectExpr("b AS a", "low AS b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").filter("b <> low").selectExpr("b AS a", "low AS b")
        links = written(small.union(down.selectExpr("a", "low AS b")).filter("a <> b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node")).distinct().selectExpr("node", "node AS component")
    return links.selectExpr("a AS node", "b AS component").union(roots)
