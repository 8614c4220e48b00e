"""Joins over paths and table names: nearest config, call edges, lineage, relative listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import arithmetic as calc
from codeharbor.functions import paths, rules
from codeharbor.operators.extraction import notebook_calls, table_refs
from codeharbor.plans.skew import SALTS, lookup_join


def decode_export(exports: DataFrame, column: str = "content", fmt: str = "SOURCE") -> DataFrame:
    """Base64 to text for SOURCE exports, the raw value where decoding fails; other formats stay."""
    if fmt.upper() not in rules.EXPORT_FORMATS:
        raise ValueError(f"Invalid format. Must be one of: {rules.EXPORT_FORMATS}")
    if fmt.upper() != "SOURCE":
        return exports
    decoded = F.try_validate_utf8(F.try_to_binary(F.col(column), F.lit("base64")).cast("string"))
    return exports.withColumn(column, F.coalesce(decoded, F.col(column)))


def relative_files(listing: DataFrame, root: str) -> DataFrame:
    """Paths below `root`, relative to it."""
    prefix = root.rstrip("/") + "/"
    return listing.filter(F.startswith("path", F.lit(prefix))).select(
        F.substring("path", len(prefix) + 1, 2147483647).alias("relative_path")
    )


def nearest_config(files: DataFrame, configs: DataFrame, levels: int = 3) -> DataFrame:
    """(path, config_path, depth): the config in the file's folder or the closest of its parents.

    Files collapse to their distinct folders first (pre-aggregated per task), the few folders look
    up at most `levels` ancestors, and the answer joins back to the files with hot folders salted.
    """
    located = files.select("path", paths.parent_dir(F.col("path")).alias("dir"))
    folders = located.select("dir").distinct()

    def ancestor(depth: int) -> Column:
        return F.regexp_replace("dir", f"(/[^/]*){{{depth}}}$", "") if depth else F.col("dir")

    climbs = folders.select(
        "dir", F.posexplode(F.array(*[ancestor(depth) for depth in range(levels)])).alias("depth", "at")
    ).withColumn("config_path", F.concat("at", F.lit("/" + rules.CONFIG_FILE)))
    found = climbs.join(configs.select("config_path").distinct(), "config_path")
    nearest = found.groupBy("dir").agg(F.min(F.struct("depth", "config_path")).alias("best"))
    return lookup_join(located, nearest, "dir", ["path"], "left", keys_from=located).select(
        "path", F.col("best.config_path").alias("config_path"), F.col("best.depth").cast("long").alias("depth")
    )


def one_per_stem(rows: DataFrame) -> DataFrame:
    """Of rows(stem, path, ...) the one with the smallest path per stem: a stem is one notebook."""
    return rows.groupBy("stem").agg(F.min_by(F.struct(*rows.columns), "path").alias("r")).select("r.*")


def call_edges(files: DataFrame) -> DataFrame:
    """(path, ordinal, callee, callee_path): notebook calls resolved to files, NULL when unknown.

    A notebook is called without its extension; of several files with that stem the smallest path
    is meant. A callee everybody calls is one hot key, hence the salted join; the text is scanned
    once, so the salt is the same for all keys.
    """
    calls = notebook_calls(files).withColumn("stem", paths.resolve(F.col("path"), F.col("callee")))
    targets = one_per_stem(files.select(paths.without_extension(F.col("path")).alias("stem"), "path")).select(
        "stem", F.col("path").alias("callee_path")
    )
    return lookup_join(calls, targets, "stem", ["path", "ordinal"]).select("path", "ordinal", "callee", "callee_path")


def lineage_tables(files: DataFrame) -> DataFrame:
    """(table_name, n_writers, n_readers, n_edges): the table side of the lineage graph."""
    return _table_degrees(table_refs(files), "table_name").withColumn("n_edges", F.col("n_writers") * F.col("n_readers"))


def _table_degrees(refs: DataFrame, *keys: str) -> DataFrame:
    known = F.col("path").isNotNull()
    return refs.groupBy(*keys).agg(
        F.count_if(known & (F.col("direction") == "output")).alias("n_writers"),
        F.count_if(known & (F.col("direction") == "input")).alias("n_readers"),
    )


def lineage_edges(files: DataFrame) -> DataFrame:
    """(path, direction, table_name, n_counterparts): the graph file - table - file.

    The table stays in the middle as a node, so the result grows with the references. Pairing
    every writer with every reader would square for a table most files touch; the number of
    pairs is `n_edges` in `lineage_tables`, and the files behind one table are its rows here.

    The text is scanned once: the references are shuffled by (table, salt) and that one exchange
    feeds both the counts and the join.
    """
    salt = F.pmod(F.xxhash64("path", "direction"), F.lit(SALTS)).cast("int")
    refs = table_refs(files).drop("n_parts").withColumn("_salt", salt)
    # spelled out, so that the join infers no further filter for one side and the exchange is shared
    refs = refs.filter(F.col("table_name").isNotNull() & F.col("_salt").isNotNull()).repartition("table_name", "_salt")
    degrees = _table_degrees(refs, "table_name", "_salt").groupBy("table_name").agg(
        F.sum("n_writers").alias("n_writers"), F.sum("n_readers").alias("n_readers")
    )
    spread = degrees.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return refs.join(spread, ["table_name", "_salt"]).select(
        "path", "direction", "table_name",
        F.when(F.col("direction") == "input", F.col("n_writers")).otherwise(F.col("n_readers")).alias("n_counterparts"),
    )


def arithmetic(rows: DataFrame) -> DataFrame:
    """The six calculator functions over (amount, customer_id)."""
    a, b = F.col("amount"), F.col("customer_id")
    return rows.select(
        "customer_id", "transaction_id",
        calc.add(a, b).alias("added"),
        calc.sub(a, b).alias("subtracted"),
        calc.mul(a, b).alias("multiplied"),
        calc.div(a, b).alias("divided"),
        calc.root(a).alias("root"),
        calc.power(b, F.lit(2)).alias("raised"),
    )
