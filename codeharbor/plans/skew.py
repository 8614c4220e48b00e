"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT_SALTS = 1024  # shared out among the hot keys by their part of the rows
HOT_PART = 1000  # a key with more than one row in so many is hot


FEW = 10_000


def few_broadcast(lookup: DataFrame, most: int = FEW) -> DataFrame:
    """The lookup with a broadcast hint if it has at most `most` rows, else as it is.

    At most one row more than that is counted, so the check costs little on a large lookup.
    """
    return F.broadcast(lookup) if lookup.limit(most + 1).count() <= most else lookup


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _salts): the keys with more than 1/HOT_PART of all rows, and the salts each needs.

    There are fewer than HOT_PART of them by arithmetic, and they share HOT_SALTS salts, so the list
    may be broadcast whatever the size of the input.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter(F.col(key).isNotNull() & (F.col("_n") * HOT_PART > total))
    return hot.select(key, F.ceil(F.col("_n") * HOT_SALTS / total).cast("int").alias("_salts"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, salt_by: list[str], how: str = "left",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a lookup with one row per key, with hot keys spread over tasks.

    The salt is a hash of the row itself, so a recomputed task gives the same rows; it needs a
    column besides the key, as rows that differ in nothing else cannot be spread.
    keys_from names a cheap frame that holds the same keys at least as often (a base table): its
    keys are counted first, one more pass over one column, and only hot ones are salted. Without
    it every key is salted a little, which suits rows that are costly to derive twice, such as
    ones extracted from text.
    """
    if set(salt_by) <= {key}:
        raise ValueError("a salt made from the key alone spreads nothing")
    if keys_from is not None:
        hot = F.broadcast(hot_keys(keys_from, key))
        # rows without a key match nothing and are spread as well
        salts = F.when(F.col(key).isNull(), F.lit(HOT_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")
        spread = lookup.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
        # planned by size, a lookup passes for one copy of itself: never broadcast its SALTS copies
        spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
