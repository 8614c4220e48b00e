"""Writers: bundle texts, JSON envelopes, result files, keyed tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeharbor.functions import rules


def readme_blocks(bundles: DataFrame) -> DataFrame:
    """One README block per bundle, in the shape `write_bundles` takes."""
    text = F.concat(
        F.lit("# "), F.col("bundle_name"),
        F.lit("\n\n```bash\ndatabricks bundle validate\ndatabricks bundle deploy -t dev\n```\n"),
    )
    return bundles.select(
        "bundle_name", F.lit("README.md").alias("file"), F.lit(0).cast("long").alias("section"),
        F.lit("").alias("sort_key"), text.alias("text"),
    )


def write_bundles(blocks: DataFrame, out: str, overwrite: bool = False) -> None:
    """Write blocks (bundle_name, section, sort_key, text[, file]) below out/bundle_name=/file=/.

    Blocks are range-partitioned in file order, so the part files of a folder, read in name
    order, are the file; a huge bundle spans several of them. Without `overwrite` an existing
    target is an error.
    """
    if "file" not in blocks.columns:
        blocks = blocks.withColumn("file", F.lit(rules.CONFIG_FILE))
    order = ["bundle_name", "file", "section", "sort_key"]
    (
        blocks.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("bundle_name", "file", F.regexp_replace("text", "\n\\z", "").alias("value"))
        .write.mode("overwrite" if overwrite else "errorifexists")
        .partitionBy("bundle_name", "file").text(out)
    )


def envelope(data: Column, error: Column, style: str = "mcp", at: Column | None = None) -> Column:
    """JSON text around a row: {success, data | error, timestamp}, or text inside content[0]."""
    if style == "sdk":
        inner = F.when(error.isNull(), F.to_json(data)).otherwise(F.to_json(F.struct(error.alias("error"))))
        return F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), inner.alias("text"))).alias("content")))
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    return F.when(
        error.isNull(), F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"), stamp))
    ).otherwise(F.to_json(F.struct(F.lit(False).alias("success"), error.alias("error"), stamp)))


def to_envelope(rows: DataFrame, style: str = "mcp", error: str = "error", at: Column | None = None) -> DataFrame:
    """One envelope per row; the rows' `error` column, if any, decides which form."""
    failed = F.col(error) if error in rows.columns else F.lit(None).cast("string")
    data = F.struct(*[F.col(c) for c in rows.columns if c != error])
    return rows.select(envelope(data, failed, style, at).alias("response"))


def write_results(summary: DataFrame, questions: DataFrame, out: str) -> None:
    """The summary row and the per-question rows as JSON, side by side."""
    summary.write.mode("overwrite").json(f"{out}/summary")
    questions.write.mode("overwrite").json(f"{out}/questions")


# ---- keyed tables -----------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _put(spark: SparkSession, path: str, value: object) -> None:
    """Write a small JSON record under another name and rename it: it is there whole or not at all."""
    fs, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not fs.rename(part, _fs(spark, path)[1]):
        fs.delete(part, False)
        if not path_exists(spark, path):
            raise OSError(f"cannot write {path}")


def _get(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by `order`. Merges per task before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in others] + [c for c in others if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*first)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def _properties(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> None:
    """Keys and order belong to the table: the first call writes them down, others must agree."""
    path, mine = f"{table}/_about/table.json", {"keys": keys, "order": order}
    if not path_exists(spark, path):
        _put(spark, path, mine)
    if _get(spark, path) != mine:
        raise ValueError(f"{table} has other keys or another order than {mine}")


def committed(spark: SparkSession, table: str) -> list[str]:
    """The batches that make up the table: those with a commit record that no later one replaces."""
    fs, folder = _fs(spark, f"{table}/_commits")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    names = sorted(n for n in names if not n.endswith(".part") and not n.startswith("."))
    replaced = {old for n in names if n.startswith("compact-") for old in _get(spark, f"{table}/_commits/{n}")}
    return [n for n in names if n not in replaced]


def append_batch(rows: DataFrame, table: str, batch: str) -> None:
    """Add rows to a table of versions, once per batch name.

    The rows go to a folder of their own and count from the moment its commit record stands. A batch
    that has one is not written again; one that died before is written anew. Nothing else is read or
    moved, so a small batch costs little however large the table is.
    """
    spark = rows.sparkSession
    record = f"{table}/_commits/{batch}"
    if not path_exists(spark, record):
        rows.write.mode("overwrite").parquet(f"{table}/versions/{batch}")
        _put(spark, record, [])


def upsert_table(changes: DataFrame, table: str, keys: list[str], order: list[str], batch: str) -> None:
    """Merge changes into a keyed table: of all rows with a key the greatest by `order` is the row.

    `batch` names these changes for good: the same name again is a repetition and changes nothing,
    so two different sets of changes need two names. Changes become versions (`append_batch`);
    `read_table` picks the latest, `compact` drops the others.
    """
    table = table.rstrip("/")
    _properties(changes.sparkSession, table, keys, order)
    append_batch(changes, table, batch)


def read_versions(spark: SparkSession, table: str) -> DataFrame:
    """All rows of the committed batches."""
    table = table.rstrip("/")
    return spark.read.parquet(*[f"{table}/versions/{batch}" for batch in committed(spark, table)])


def read_table(spark: SparkSession, table: str) -> DataFrame:
    told = _get(spark, f"{table.rstrip('/')}/_about/table.json")
    return latest(read_versions(spark, table), told["keys"], told["order"])


def compact(spark: SparkSession, table: str) -> None:
    """Rewrite the table as one batch of latest rows; the commit record names the batches it replaces.

    Run it on a schedule, not beside readers that still use the old folders: those are removed last.
    """
    table = table.rstrip("/")
    old, new = committed(spark, table), f"compact-{uuid.uuid4().hex}"
    read_table(spark, table).write.parquet(f"{table}/versions/{new}")
    _put(spark, f"{table}/_commits/{new}", old)
    for batch in old:
        _remove(spark, f"{table}/versions/{batch}")
