"""The table and training workloads on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeharbor.catalog.views import CUSTOMERS, over
from codeharbor.operators import training as ml
from codeharbor.operators import workloads as wl
from codeharbor.plans.running import stored
from codeharbor.session import checkpoint_dir
from codeharbor.sources.assets import asset, customers
from codeharbor.sources.corpus import load

QUERIES = {}
ORACLE = {}


def on(name, sql, fn, *ctes):
    """`fn` takes (spark, transactions, customers)."""
    QUERIES[name] = lambda spark, sf_dir: fn(spark, asset(spark, sf_dir, "transactions"), customers(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = over(sql, "transactions", CUSTOMERS, *ctes)


def dated(frame, column="transaction_date"):
    return frame.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


TOTAL = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
on("e1_quality_profile", """SELECT strftime(transaction_date, '%Y-%m-%d') AS transaction_date, count(*) AS total_records,
    count(DISTINCT transaction_id) AS unique_transactions, count(*) FILTER (amount IS NULL) AS null_amounts
  FROM transactions GROUP BY 1""", lambda s, t, c: dated(wl.quality_profile(t)))
CLEAN = """clean AS MATERIALIZED (SELECT transaction_id, customer_id, amount, transaction_date FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY customer_id, amount, transaction_date) AS rn
  FROM transactions WHERE amount > 0 AND transaction_id IS NOT NULL) WHERE rn = 1)"""
on("e2_clean_facts", """SELECT transaction_id, customer_id, amount, strftime(transaction_date, '%Y-%m-%d') AS transaction_date
  FROM clean""", lambda s, t, c: dated(wl.clean_facts(t)), CLEAN)
ENRICHED = """enriched AS (SELECT t.*, customer_name, customer_segment, region FROM clean t
  LEFT JOIN customers c ON t.customer_id = c.id)"""
on("e3_enrich", """SELECT transaction_id, customer_id, amount, strftime(transaction_date, '%Y-%m-%d') AS transaction_date,
    customer_name, customer_segment, region FROM enriched""",
   lambda s, t, c: dated(wl.enrich(wl.clean_facts(t), c, t)), CLEAN, ENRICHED)
SUMMARY = f"""customer_segment, region, count(transaction_id) AS transaction_count, {TOTAL.format('amount')} AS total_revenue,
  {TOTAL.format('amount')} / count(amount) AS avg_transaction_value"""


def summary(t, c, day=None):
    marked = F.lit("2024-01-01" if day is None else day).cast("date")
    return wl.daily_summary(wl.enrich(wl.clean_facts(t), c, t), "dev", marked)


on("e4_daily_summary", f"""SELECT {SUMMARY}, '2024-01-01' AS processing_date, 'dev' AS environment FROM enriched
  GROUP BY customer_segment, region""", lambda s, t, c: dated(summary(t, c), "processing_date"), CLEAN, ENRICHED)
PER_YEAR = f"""per_year AS MATERIALIZED (SELECT year(transaction_date)::BIGINT AS sale_year, {SUMMARY} FROM enriched
  GROUP BY 1, customer_segment, region)"""


def per_year(t, c):
    enriched = wl.enrich(wl.clean_facts(t), c, t).withColumn("sale_year", F.year("transaction_date").cast("long"))
    return enriched.groupBy("sale_year", "customer_segment", "region").agg(
        F.count("transaction_id").alias("transaction_count"),
        wl.exact_sum(F.col("amount")).alias("total_revenue"),
        wl.exact_avg(F.col("amount")).alias("avg_transaction_value"),
    )


def upserted(t, c):
    """Yearly totals over all sales, overwritten by those over large sales where there are any."""
    keys = ["sale_year", "customer_segment", "region"]
    large = per_year(t.filter("amount > 100000"), c)
    return wl.upsert(per_year(t, c), large, keys)


on("e5_upsert", f"""SELECT * FROM per_year p WHERE NOT EXISTS (SELECT 1 FROM large l WHERE l.sale_year = p.sale_year
    AND l.customer_segment = p.customer_segment AND l.region = p.region) UNION ALL SELECT * FROM large""",
   lambda s, t, c: upserted(t, c), CLEAN, ENRICHED, PER_YEAR,
   CLEAN.replace("clean AS", "clean_large AS").replace("amount > 0", "amount > 0 AND amount > 100000"),
   ENRICHED.replace("enriched AS", "enriched_large AS").replace("FROM clean", "FROM clean_large"),
   PER_YEAR.replace("per_year AS", "large AS").replace("FROM enriched", "FROM enriched_large"))
on("e6_segment_totals", f"""SELECT customer_segment, region, {TOTAL.format('total_revenue')} AS total,
    round(avg(avg_transaction_value), 4) AS avg_value FROM per_year GROUP BY ALL ORDER BY total DESC""",
   lambda s, t, c: wl.segment_totals(per_year(t, c)).withColumn("avg_value", F.round("avg_value", 4)),
   CLEAN, ENRICHED, PER_YEAR)
on("e7_customer_metrics", f"""SELECT customer_id, count(*) AS transaction_count, {TOTAL.format('amount')} AS total_spent,
    {TOTAL.format('amount')} / count(amount) AS avg_transaction FROM transactions JOIN customers ON customer_id = id
  WHERE transaction_date >= DATE '1998-01-01' GROUP BY customer_id HAVING count(amount) > 0""",
   lambda s, t, c: wl.customer_metrics(s, t, c, "1998-01-01"))

WIDE_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]
QUERIES["e8_wide_aggregate"] = lambda spark, sf_dir: wl.wide_aggregate(
    load(spark, sf_dir, "lineitem"), WIDE_KEYS, "l_extendedprice", 1_000_000).withColumn("std_dev", F.round("std_dev", 4))
ORACLE["e8_wide_aggregate"] = f"""SELECT {', '.join(WIDE_KEYS)}, {TOTAL.format('l_extendedprice')} AS total,
    {TOTAL.format('l_extendedprice')} / count(*) AS average, round(stddev(l_extendedprice), 4) AS std_dev, count(*) AS n_rows
  FROM lineitem GROUP BY ALL HAVING {TOTAL.format('l_extendedprice')} > 1000000"""
QUERIES["e8_wide_details"] = lambda spark, sf_dir: wl.wide_details(
    load(spark, sf_dir, "lineitem"), WIDE_KEYS, "l_partkey").select(*WIDE_KEYS, F.inline("details"))
ORACLE["e8_wide_details"] = f"""SELECT {', '.join(WIDE_KEYS)}, l_partkey AS detail, count(*) AS n
  FROM lineitem GROUP BY ALL"""



def _write_wide(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/wide-{uuid.uuid4()}"
    wl.write_wide(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), path, "l_returnflag")
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys"))


QUERIES["e8_write_wide"] = _write_wide
ORACLE["e8_write_wide"] = """SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS keys
  FROM lineitem GROUP BY l_returnflag"""

# ---- training ------------------------------------------------------------------------------------

FEATURES = ["n_chars", "n_lines", "n_digits", "n_upper"]
FEATURE_EXPRESSIONS = [
    "CAST(n_chars AS DOUBLE) AS n_chars",
    "CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS n_lines",
    "CAST(length(text) - length(translate(text, '0123456789', '')) AS DOUBLE) AS n_digits",
    "CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS DOUBLE) AS n_upper",
]
LABELLED = f"""labelled AS MATERIALIZED (SELECT doc_id, quality, toxic, {', '.join(FEATURE_EXPRESSIONS)}
  FROM documents JOIN labels USING (doc_id))"""
SPLIT = """split AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id)
  <= floor(0.8 * count(*) OVER (PARTITION BY quality)) AS is_train FROM labelled)"""


def features(spark, sf_dir):
    """The text of every document reduced to four numbers."""
    return load(spark, sf_dir, "documents").selectExpr("doc_id", *FEATURE_EXPRESSIONS)


def labelled(spark, sf_dir):
    """Feature rows: the text is reduced to four numbers before the join."""
    return features(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", *FEATURES)


def split(spark, sf_dir):
    """(doc_id, quality, toxic, is_train) of the labelled documents: the levels of the split see no text."""
    known = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return ml.stratified_split(stored(known, "labels"), "doc_id", "quality")


def scaled(spark, sf_dir):
    """The split rows with scaled features: split and texts are read once, statistics come from the stored rows."""
    rows = stored(features(spark, sf_dir).join(split(spark, sf_dir), "doc_id"), "split")
    return ml.scale(rows, rows.filter("is_train"), FEATURES)


QUERIES["e9_stratified_split"] = lambda spark, sf_dir: split(spark, sf_dir).select("doc_id", "quality", "is_train")
ORACLE["e9_stratified_split"] = over("SELECT doc_id, quality, is_train FROM split", LABELLED, SPLIT)
QUERIES["e10_scale"] = lambda spark, sf_dir: scaled(spark, sf_dir).select(
    "doc_id", "is_train", *[F.round(c, 6).alias(c) for c in FEATURES])
ORACLE["e10_scale"] = over("SELECT doc_id, is_train, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM split WHERE is_train)) / "
    f"(SELECT stddev_pop({c}) FROM split WHERE is_train), 6) AS {c}" for c in FEATURES) + " FROM split", LABELLED, SPLIT)


GRID = {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [2, 5]}
FOLDS, FIT_ROWS = 5, 2000
FOLD = f"CAST(pmod(CAST(conv(substring(md5(doc_id || ':11'), 1, 8), 16, 10) AS BIGINT), {FOLDS}) AS INT) AS fold"


def _sample(rows):
    """At most FIT_ROWS training rows, the first by split key, with their fold; cached in one partition."""
    rows = ml.assemble(rows, FEATURES).filter("is_train").orderBy(ml.split_key(F.col("doc_id"), 7), "doc_id").limit(FIT_ROWS)
    return rows.select("doc_id", "quality", "features", F.expr(FOLD)).coalesce(1).cache()


def _grid_search(spark, sf_dir):
    """Every combination with its F1 over the folds. Its model is another with every sample, so there is no SQL
    for it: tests work the scores out by hand."""
    sample = _sample(scaled(spark, sf_dir))
    _, scores = ml.grid_search(sample, "quality", GRID, FOLDS, fold="fold")
    sample.unpersist()
    told = [(s["numTrees"], s["maxDepth"], s["minInstancesPerNode"], FOLDS, s["f1"]) for s in scores]
    return spark.createDataFrame(told, "num_trees long, max_depth long, min_instances long, folds long, f1 double")


PART_ROWS = 20_000


def _training(rows):
    """All training rows with their fold, cached: PART_ROWS of them a partition, each with the same rows on every run."""
    rows = ml.assemble(rows, FEATURES).filter("is_train").select("doc_id", "quality", "features", F.expr(FOLD))
    parts = rows.count() // PART_ROWS + 1
    return rows.repartition(parts, "doc_id").sortWithinPartitions(ml.split_key(F.col("doc_id"), 7), "doc_id").cache()


def _fitted(spark, sf_dir):
    """(all split rows, the best forest of the whole grid): searched over and fitted to all training rows."""
    rows = scaled(spark, sf_dir)
    train = _training(rows)
    model, _ = ml.grid_search(train, "quality", GRID, FOLDS, fold="fold")
    train.unpersist()
    return ml.assemble(rows, FEATURES), model


def _importances(spark, sf_dir):
    """The importance of each feature in the best forest; no SQL, as above."""
    return ml.importances(_fitted(spark, sf_dir)[1], FEATURES)


def _predictions(spark, sf_dir):
    """Every test row with its actual and predicted class, appended to a table and read back."""
    rows, model = _fitted(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/predictions-{uuid.uuid4()}"
    told = model.transform(rows.filter("NOT is_train")).select(
        "doc_id", F.col("quality").alias("actual"), F.col("prediction").cast("int").alias("predicted"))
    ml.append_predictions(told, path)
    return spark.read.parquet(path)


QUERIES["e11_grid_search"] = _grid_search
QUERIES["e13_importances"] = _importances
QUERIES["e14_append_predictions"] = _predictions
QUERIES["e12_binary_metrics"] = lambda spark, sf_dir: ml.binary_metrics(
    labelled(spark, sf_dir).selectExpr("quality AS actual", "CASE WHEN n_digits < 10 THEN 1 ELSE 0 END AS predicted")
).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
ORACLE["e12_binary_metrics"] = over("""SELECT round(count(*) FILTER (a = p) / count(*)::DOUBLE, 6) AS accuracy,
    round(count(*) FILTER (a = 1 AND p = 1) / (count(*) FILTER (p = 1))::DOUBLE, 6) AS precision,
    round(count(*) FILTER (a = 1 AND p = 1) / (count(*) FILTER (a = 1))::DOUBLE, 6) AS recall,
    round(2 * count(*) FILTER (a = 1 AND p = 1) / (count(*) FILTER (a = 1) + count(*) FILTER (p = 1))::DOUBLE, 6) AS f1
  FROM (SELECT quality AS a, CASE WHEN n_digits < 10 THEN 1 ELSE 0 END AS p FROM labelled)""", LABELLED)
