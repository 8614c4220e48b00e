"""Table workloads: profile, clean, enrich, summarise, upsert, wide aggregates.

transactions(transaction_id, customer_id, amount, transaction_date);
customers(id, customer_name, customer_segment, region).
Money is summed as decimals, so a total does not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeharbor.plans.skew import lookup_join

CENTS = "decimal(18,2)"
ROWS_PER_LIST = 1000


def exact_sum(amount: Column) -> Column:
    return F.sum(amount.cast(CENTS)).cast("double")


def exact_avg(amount: Column) -> Column:
    return F.try_divide(exact_sum(amount), F.count(amount))


def _on_date(rows: DataFrame, date: str | None) -> DataFrame:
    return rows if date is None else rows.filter(F.col("transaction_date") == F.to_date(F.lit(date)))


def quality_profile(transactions: DataFrame, date: str | None = None) -> DataFrame:
    """(transaction_date, total_records, unique_transactions, null_amounts) per day, or one day."""
    return _on_date(transactions, date).groupBy("transaction_date").agg(
        F.count("*").alias("total_records"),
        F.count_distinct("transaction_id").alias("unique_transactions"),
        F.count_if(F.col("amount").isNull()).alias("null_amounts"),
    )


def clean_facts(transactions: DataFrame, date: str | None = None) -> DataFrame:
    """Positive amounts with an id, one row per id: the smallest one, so the choice is repeatable.

    The minimum merges per task before the shuffle; an id that a third of the rows share is one
    row per task by then.
    """
    others = [c for c in transactions.columns if c != "transaction_id"]
    kept = _on_date(transactions, date).filter((F.col("amount") > 0) & F.col("transaction_id").isNotNull())
    return kept.groupBy("transaction_id").agg(F.min(F.struct(*others)).alias("r")).select("transaction_id", "r.*")


def enrich(facts: DataFrame, customers: DataFrame, keys_from: DataFrame | None = None) -> DataFrame:
    """Facts with the customer's name, segment and region; NULL for an unknown customer.

    keys_from: the base table of the facts, to find customers with very many of them.
    """
    lookup = customers.select(F.col("id").alias("customer_id"), "customer_name", "customer_segment", "region")
    return lookup_join(facts, lookup, "customer_id", ["transaction_id", "amount"], "left", keys_from)


def daily_summary(enriched: DataFrame, environment: str = "dev", processing_date: Column | None = None) -> DataFrame:
    """Count, sum and average by segment and region, with two literal columns."""
    return (
        enriched.groupBy("customer_segment", "region").agg(
            F.count("transaction_id").alias("transaction_count"),
            exact_sum(F.col("amount")).alias("total_revenue"),
            exact_avg(F.col("amount")).alias("avg_transaction_value"),
        )
        .withColumn("processing_date", F.current_date() if processing_date is None else processing_date)
        .withColumn("environment", F.lit(environment))
    )


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not in the source, and all source rows. NULL keys never match."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def segment_totals(summary: DataFrame) -> DataFrame:
    return (
        summary.groupBy("customer_segment", "region")
        .agg(exact_sum(F.col("total_revenue")).alias("total"), F.avg("avg_transaction_value").alias("avg_value"))
        .orderBy(F.desc("total"))
    )


def customer_metrics(spark: SparkSession, transactions: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    """Count, sum and average per known customer since a date.

    Sums come before the join: the join then sees one row per customer, whatever the skew.
    """
    return spark.sql(
        f"""
        SELECT m.customer_id, transaction_count, total_spent, total_spent / amounts AS avg_transaction
        FROM (
          SELECT customer_id, count(*) AS transaction_count, count(amount) AS amounts,
                 CAST(sum(CAST(amount AS {CENTS})) AS DOUBLE) AS total_spent
          FROM {{t}} WHERE transaction_date >= CAST(:since AS DATE) GROUP BY customer_id
        ) m JOIN {{c}} c ON m.customer_id = c.id
        WHERE amounts > 0
        """,
        args={"since": since},
        t=transactions,
        c=customers,
    )


def create_customer_metrics(
    spark: SparkSession, transactions: DataFrame, customers: DataFrame, since: str, table: str, path: str, buckets: int = 64
) -> DataFrame:
    """Create the catalog table of `customer_metrics` at a path, or replace it, and give it back.

    It is bucketed and sorted by customer_id, so a join or grouping on that key reads it in place: that
    side needs no exchange.
    """
    metrics = customer_metrics(spark, transactions, customers, since)
    metrics.write.mode("overwrite").option("path", path).bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(table)
    return spark.table(table)


def wide_aggregate(rows: DataFrame, keys: list[str], value: str, having: float) -> DataFrame:
    """Sum, average and standard deviation by keys, for groups whose sum exceeds `having`."""
    return rows.groupBy(*keys).agg(
        exact_sum(F.col(value)).alias("total"),
        exact_avg(F.col(value)).alias("average"),
        F.stddev(value).alias("std_dev"),
        F.count("*").alias("n_rows"),
    ).filter(F.col("total") > having)


def wide_details(rows: DataFrame, keys: list[str], detail: str) -> DataFrame:
    """(keys, chunk_no, details): the details of each group as lists of struct(detail, n).

    Equal details collapse to one entry with its count before they move, and a group is cut into
    as many lists as its entries need, so no list outgrows ROWS_PER_LIST by more than chance.
    """
    entries = rows.groupBy(*keys, detail).agg(F.count("*").alias("n")).withColumn("_group", F.struct(*keys))
    lists = entries.groupBy("_group").agg(F.ceil(F.count("*") / ROWS_PER_LIST).alias("_lists"))
    chunk = F.pmod(F.xxhash64(detail), F.col("_lists")).alias("chunk_no")
    return (
        lookup_join(entries, lists, "_group", [detail], "inner").groupBy(*keys, chunk)
        .agg(F.collect_list(F.struct(F.col(detail).alias("detail"), "n")).alias("details"))
    )


def write_wide(result: DataFrame, path: str, partition_key: str) -> None:
    """One folder per value of the partition column; a value with very many rows is split over tasks."""
    result.hint("rebalance", F.col(partition_key)).write.mode("overwrite").partitionBy(partition_key).parquet(path)
