"""Skewed inputs: one key holds a third of the rows or more. Results must be whole and equal to
a plain computation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeharbor.operators import inventory, lineage, training, workloads
from codeharbor.plans import skew


def skewed(n=900, seed=3):
    pick = random.Random(seed)
    return [(i, "hot" if pick.random() < 0.4 else pick.choice(["a", "b", "c", None, "gone"])) for i in range(n)]


def test_lookup_join_equals_a_plain_join(spark, rows):
    left = spark.createDataFrame(skewed(), "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("c", 4), ("unused", 5)], "k string, v long")
    for how in ("left", "inner"):
        plain = rows(left.join(right, "k", how), "i", "k", "v")
        assert rows(skew.lookup_join(left, right, "k", ["i"], how), "i", "k", "v") == plain
        assert rows(skew.lookup_join(left, right, "k", ["i"], how, keys_from=left), "i", "k", "v") == plain


def test_hot_keys_are_those_with_a_large_part_and_share_the_salts(spark, monkeypatch):
    left = spark.createDataFrame(skewed() + [(1000 + i, f"k{i % 60}") for i in range(2400)], "i long, k string")
    counts = {r.k: r["count"] for r in left.groupBy("k").count().collect()}
    for part in (10, 20, 1000):
        monkeypatch.setattr(skew, "HOT_PART", part)
        hot = {r.k: r["_salts"] for r in skew.hot_keys(left, "k").collect()}
        assert set(hot) == {k for k, n in counts.items() if k is not None and n * part > 3300} and len(hot) < part
        assert all(s >= 1 for s in hot.values()) and sum(hot.values()) <= skew.HOT_SALTS + len(hot)


def test_a_salt_needs_more_than_the_key(spark):
    left, right = spark.createDataFrame([(1, "a")], "i long, k string"), spark.createDataFrame([("a", 1)], "k string, v long")
    with pytest.raises(ValueError, match="spreads nothing"):
        skew.lookup_join(left, right, "k", ["k"])


def test_hot_key_is_spread_over_salts(spark):
    left = spark.createDataFrame(skewed(), "i long, k string").filter("k = 'hot'")
    salts = left.select(F.pmod(F.xxhash64("i"), F.lit(skew.HOT_SALTS)).alias("s")).groupBy("s").count()
    assert salts.count() > min(skew.HOT_SALTS, left.count()) // 2
    assert salts.agg(F.max("count")).first()[0] < left.count() / 8


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(400).selectExpr("id AS i", "CASE WHEN id < 0 THEN CAST(id AS STRING) END AS k")
    right = spark.createDataFrame([("a", 1)], "k string, v long")
    joined = skew.lookup_join(left, right, "k", ["i"], "left", keys_from=left)
    assert joined.count() == 400 and joined.filter("v IS NULL").count() == 400
    plan = skew.lookup_join(left, right, "k", ["i"], "left", keys_from=left)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(k" in plan


def test_enrich_with_a_hot_customer(spark, rows):
    pick = random.Random(1)
    facts = spark.createDataFrame(
        [(i, 7 if i % 2 else pick.randint(0, 30), float(i)) for i in range(500)],
        "transaction_id long, customer_id long, amount double")
    customers = spark.createDataFrame([(i, f"n{i}", "s", "r") for i in range(20)],
                                      "id long, customer_name string, customer_segment string, region string")
    got = rows(workloads.enrich(facts, customers, facts), "transaction_id", "customer_name")
    want = [(i, f"n{c}" if c < 20 else None) for i, c, _ in facts.collect()]
    assert got == sorted(want, key=repr)


def test_clean_facts_with_one_id_for_a_third_of_the_rows(spark, rows):
    data = [(1 if i % 3 == 0 else i, i % 5, float(i % 7)) for i in range(300)] + [(None, 1, 5.0)]
    frame = spark.createDataFrame(data, "transaction_id long, customer_id long, amount double")
    best = {}
    for t, c, a in data:
        if t is not None and a > 0:
            best[t] = min(best.get(t, (c, a)), (c, a))
    assert rows(workloads.clean_facts(frame)) == sorted(((t, *v) for t, v in best.items()), key=repr)


def test_wide_details_are_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(workloads, "ROWS_PER_LIST", 50)
    data = [("x", "copy" if i % 3 == 0 else f"d{i}") for i in range(3000)] + [("y", "only")]
    lists = workloads.wide_details(spark.createDataFrame(data, "k string, d string"), ["k"], "d").collect()
    told = {}
    for r in lists:
        for entry in r.details:
            assert (r.k, entry.detail) not in told
            told[r.k, entry.detail] = entry.n
    assert told[("x", "copy")] == 1000 and sum(told.values()) == 3001 and len(told) == 2002
    assert max(len(r.details) for r in lists) < 150


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_split_equals_ranking_every_row(spark, monkeypatch, digits):
    monkeypatch.setattr(training, "BUCKET_DIGITS", digits)
    labelled = spark.createDataFrame([(i, 0 if i % 9 else 1) for i in range(700)], "id long, y int")
    got = {r.id: r.is_train for r in training.stratified_split(labelled, "id", "y").collect()}
    import hashlib
    for y in (0, 1):
        ids = sorted((i for i in range(700) if (0 if i % 9 else 1) == y),
                     key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        cut = int(0.8 * len(ids) + 1e-9)
        assert {i for i in ids if got[i]} == set(ids[:cut])
    assert len(got) == 700


def test_split_keeps_rows_without_a_label(spark):
    labelled = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, y int")
    got = training.stratified_split(labelled, "id", "y").collect()
    assert len(got) == 50
    for y in (None, 0, 1):
        assert sum(r.is_train for r in got if r.y == y) == 8 * sum(r.y == y for r in got) // 10


def test_scaling_reads_the_training_rows_once(spark):
    import math

    frame = spark.createDataFrame([(float(i), float(i * i), 7.0) for i in range(9)], "a double, b double, c double")
    got = training.scale(frame, frame.filter("a < 5"), ["a", "b", "c"])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"[Ss]ubquery subquery#(\d+)", plan))) == 1
    deviation = math.sqrt(sum((x - 2) ** 2 for x in range(5)) / 5)
    assert [r.a for r in got.orderBy("a").collect()] == pytest.approx([(i - 2) / deviation for i in range(9)])
    assert {r.c for r in got.collect()} == {0.0}


def test_one_file_per_stem(spark, rows):
    from codeharbor.operators import config

    files = spark.createDataFrame([("/p/etl.py", "import mlflow"), ("/p/etl.sql", "SELECT 1"), ("/p/main.py", "dbutils.notebook.run('./etl', 60)")], "path string, content string")
    assert rows(lineage.call_edges(files), "path", "callee_path") == [("/p/main.py", "/p/etl.py")]
    bundles = spark.createDataFrame([("b", "/p/etl"), ("b", "/p/gone")], "bundle_name string, stem string")
    got = config.bundle_files(bundles, files).collect()
    assert sorted((r.stem, r.error is None) for r in got) == [("/p/etl", True), ("/p/gone", False)]
    assert [r.uses_mlflow for r in got if r.stem == "/p/etl"] == [True]


def test_sources_are_joined_without_copies(spark, rows):
    from codeharbor.sources.files import read_sources

    wanted = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    local = spark.createDataFrame([("/a", "x")], "path string, content string")
    exports = spark.createDataFrame([("/a", "eQ=="), ("/b", "eg==")], "path string, content string")
    found = read_sources(wanted, local, exports)
    assert rows(found) == [("/a", "x", None), ("/b", "z", None), ("/c", None, "File not found: /c")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_of_a_table_everybody_uses(spark, rows):
    texts = [(f"/w{i}.py", "x.saveAsTable('a.hot')") for i in range(40)]
    texts += [(f"/r{i}.py", "spark.table('a.hot'); spark.table('a.cold')") for i in range(60)]
    files = spark.createDataFrame(texts, "path string, content string")
    edges = lineage.lineage_edges(files)
    assert edges.count() == 40 + 120  # grows with the references, not with writer-reader pairs
    assert rows(edges.select("direction", "table_name", "n_counterparts").distinct()) == [
        ("input", "a.cold", 0), ("input", "a.hot", 40), ("output", "a.hot", 60)]
    assert rows(lineage.lineage_tables(files)) == [("a.cold", 0, 60, 0), ("a.hot", 40, 60, 2400)]


def test_lineage_reads_the_text_once(spark):
    files = spark.createDataFrame([("/a.py", "spark.table('a.b')")], "path string, content string")
    path = spark.conf.get("spark.checkpoint.dir") + "/lineage-once"
    files.write.mode("overwrite").parquet(path)
    edges = lineage.lineage_edges(spark.read.parquet(path))
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_nearest_config(spark, rows):
    files = spark.createDataFrame([("/u/a/b/n1.py",), ("/u/a/n2.py",), ("/u/x/y/z/n3.py",), ("/n4.py",)]
                                  + [(f"/u/a/b/m{i}.py",) for i in range(50)], "path string")
    configs = spark.createDataFrame([("/u/databricks.yml",), ("/u/a/b/databricks.yml",), ("/databricks.yml",)], "config_path string")
    got = {p: (c, d) for p, c, d in lineage.nearest_config(files, configs).collect()}
    assert got["/u/a/b/n1.py"] == ("/u/a/b/databricks.yml", 0)
    assert got["/u/a/n2.py"] == ("/u/databricks.yml", 1)
    assert got["/u/x/y/z/n3.py"] == (None, None)
    assert got["/n4.py"] == ("/databricks.yml", 0)
    assert len(got) == 54


def test_call_edges(spark, rows):
    files = spark.createDataFrame(
        [("/w/main.py", "dbutils.notebook.run('./lib')\ndbutils.notebook.run(\"../o/x\")\ndbutils.notebook.run('/none')"),
         ("/w/lib.sql", "select 1"), ("/o/x.py", "dbutils.notebook.run('x')")], "path string, content string")
    assert rows(lineage.call_edges(files)) == sorted([
        ("/w/main.py", 1, "./lib", "/w/lib.sql"), ("/w/main.py", 2, "../o/x", "/o/x.py"),
        ("/w/main.py", 3, "/none", None), ("/o/x.py", 1, "x", "/o/x.py")], key=repr)


def test_inventory_answers(spark, rows):
    jobs = spark.createDataFrame(
        [(1, "Nightly ETL", 30, "ann"), (2, None, 10, "bob"), (3, "etl-2", 10, "cy"), (4, "x", 40, None)],
        "job_id long, name string, created_time long, creator_user_name string")
    tasks = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a"), (3, "b"), (4, "a")], "job_id long, task_key string")
    assert rows(inventory.list_jobs(jobs, 1, "ETL"), "job_id") == [(1,)]
    assert rows(inventory.list_jobs(jobs, None, "etl"), "job_id") == [(1,), (3,)]
    assert rows(inventory.oldest_job(jobs)) == [(2, 10)]
    assert rows(inventory.busiest_creator(jobs, tasks)) == [("ann", 1, 2)]
    assert rows(inventory.get_cluster(spark.createDataFrame(
        [("c", "n", "v", "t", 1, "R")],
        "cluster_id string, cluster_name string, spark_version string, node_type_id string, num_workers int, state string"),
        "zz", "sdk"), "cluster_id", "error") == [(None, "cluster zz not found")]
    notebooks = spark.createDataFrame([("/a/n1", None, 1, 1), ("/a/b/n2", "SQL", 1, 1), ("/ab/n3", "R", 1, 1)],
                                      "path string, language string, size long, modified_at long")
    assert rows(inventory.list_notebooks(notebooks, "/a"), "path", "language") == [("/a/n1", "UNKNOWN")]
    assert rows(inventory.list_notebooks(notebooks, "/a/", True), "path") == [("/a/b/n2",), ("/a/n1",)]
    assert inventory.list_notebooks(notebooks, "/", True, 2).count() == 2


def test_upsert(spark, rows):
    target = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (None, "c", 30)], "k long, s string, v long")
    source = spark.createDataFrame([(1, "b", 21), (2, "b", 22), (None, "c", 31)], "k long, s string, v long")
    assert rows(workloads.upsert(target, source, ["k", "s"])) == sorted(
        [(1, "a", 10), (None, "c", 30), (1, "b", 21), (2, "b", 22), (None, "c", 31)], key=repr)


def test_scale_and_metrics(spark):
    data = spark.createDataFrame([(float(i), 5.0, i < 8) for i in range(10)], "x double, c double, is_train boolean")
    got = training.scale(data, data.filter("is_train"), ["x", "c"]).collect()
    mean, deviation = 3.5, (sum((i - 3.5) ** 2 for i in range(8)) / 8) ** 0.5
    assert [r.x for r in got] == pytest.approx([(i - mean) / deviation for i in range(10)])
    assert {r.c for r in got} == {0.0}
    told = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "actual int, predicted int")
    row = training.binary_metrics(told).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == pytest.approx((0.6, 2 / 3, 2 / 3, 2 / 3))
    none = training.binary_metrics(told.filter("actual = 0 AND predicted = 0")).first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0, 0.0)


def test_copies_of_a_lookup_are_never_broadcast(spark):
    left, right = (spark.range(n).selectExpr("id AS i", "id % 7 AS k") for n in (500, 7))
    right = right.withColumnRenamed("i", "v")
    assert "Broadcast" not in skew.lookup_join(left, right, "k", ["i"])._jdf.queryExecution().executedPlan().toString()


def test_validate_keeps_one_copy_of_a_config(spark, rows):
    from codeharbor.operators import config

    runs = spark.range(300).selectExpr(
        "id AS run_id", "CASE WHEN id % 2 = 0 THEN '/b/hot' WHEN id % 5 <> 0 THEN '/b/' || id % 9 END AS bundle_path", "'dev' AS target", "0L AS return_code", "'' AS stdout", "'' AS stderr")
    configs = spark.createDataFrame([(f"/b/{i}/databricks.yml", "password: x" if i == "hot" else "autotermination_minutes", "dev") for i in ("hot", 1, 3)],
                                    "path string, content string, target string")
    joined = config.validate(runs, configs)
    assert "sequence(0, 31" not in joined._jdf.queryExecution().analyzed().toString()
    got = rows(joined, "run_id", "score", "security_passed")
    want = []
    for i in range(300):
        key = "hot" if i % 2 == 0 else i % 9 if i % 5 else None
        want.append((i, *({"hot": (75, False), 1: (85, True), 3: (85, True)}.get(key, (None, None)))))
    assert got == sorted(want, key=repr)
