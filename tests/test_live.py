"""Streams with state, changing folders, running totals, nested statements, named files, keyed tables."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codeharbor.operators import agentlog, config, extraction, statements, workloads
from codeharbor.plans import analysis, running, skew
from codeharbor.sources import files as src
from codeharbor.sources import keyed, sinks
from codeharbor.sources.bundle_files import write_bundle_files
from codeharbor.streaming import changes, streams, turns

from test_agents import MESSAGES, SCHEMA

# ---- closed turns ---------------------------------------------------------------------------------------


def dated(spark, rows, start=1_700_000_000):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("ts", F.timestamp_seconds(F.lit(start) + F.col("seq") * 10))


def run_turns(spark, path, schema, per_trigger=1):
    stream = streams.table_stream(spark, f"{path}/in", "*.parquet", schema, per_trigger)
    query = turns.start_stateful(turns.closed_turns(stream), f"{path}/out", f"{path}/cp")
    query.awaitTermination()
    return query


def told(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(turns.OUTPUT).parquet(f"{path}/out").collect()), key=repr)


def test_turns_are_told_once_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path)
    frame = dated(spark, MESSAGES)
    for part in (2, 0, 1):  # out of order, a file at a time
        frame.filter(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)
    assert told(spark, path) == []  # the watermark has passed neither a result nor an idle turn
    clock = [("clock", 0, 0, "user", "text", None, None, None, None)]
    dated(spark, clock, 1_700_000_800).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)  # a restart: the same checkpoint, state kept
    first = ("s", 0, "result", 7, ["run_job", "subagent:analyst"], "Go. ```yaml\nbundle: 1\n```Java", "bundle: 1", 0.5)
    assert told(spark, path) == [first]
    dated(spark, clock, 1_700_009_000).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)
    rest = [("s", 1, "timer", 4, ["execute_dbsql"], "```\nresources: 2\n``` JavaScript", "resources: 2", None),
            ("t", 0, "timer", 2, ["subagent:unknown", "Read"], "", None, None)]
    assert [r for r in told(spark, path) if r[0] != "clock"] == [first, *rest]


def test_repeated_and_late_messages_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    frame = dated(spark, [m for m in MESSAGES if m[:2] == ("s", 0)])
    for _ in range(2):  # the same messages delivered twice
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    dated(spark, [("clock", 0, 0, "user", "text", None, None, None, None)], 1_700_001_000).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)
    straggler = [("s", 0, 99, "assistant", "text", None, None, "too late", None)]
    dated(spark, straggler).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)
    assert [r[:4] for r in told(spark, path)] == [("s", 0, "result", 7)]


def test_only_marks_and_open_turns_stay_in_state(spark, tmp_path):
    path = str(tmp_path)
    rows = [(f"s{i}", 0, k, "result" if k == 4 else "assistant", "text", None, None, "x", None) for i in range(20) for k in range(5)]
    frame = dated(spark, rows)
    frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    for at in (1_700_001_000, 1_700_020_000, 1_700_040_000):
        dated(spark, [("clock", at, 0, "user", "text", None, None, None, None)], at).coalesce(1).write.mode("append").parquet(f"{path}/in")
    query = run_turns(spark, path, frame.schema)
    assert len([r for r in told(spark, path) if r[0] != "clock"]) == 20
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 12  # of the last clock turns alone
    with pytest.raises(ValueError, match="time span"):
        turns.closed_turns(frame, idle="soon")


# ---- files that change -----------------------------------------------------------------------------------


def put(folder, name, content, at):
    (folder / name).write_text(content)
    os.utime(folder / name, (at, at))


def test_a_synced_folder_equals_a_batch_run(spark, tmp_path, rows):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()

    def check():
        files = src.read_files(spark, str(inbox), "*.py")
        assert rows(changes.read_refs(spark, table)) == rows(extraction.table_refs(files))
        columns = ["path", "file_type", "workflow_type", "input_tables", "modules", "features", "params"]
        assert rows(changes.read_analysis(spark, table), *columns) == rows(analysis.analyze(files), *columns)

    for i in range(5):
        put(inbox, f"n{i}.py", f"import pandas\ndf = spark.table('main.raw.t{i}')\n", 1_700_000_000 + i)
    changes.sync_folder(spark, str(inbox), "*.py", table, "run0")
    check()
    put(inbox, "n1.py", "spark.table('main.raw.other')\n", 1_700_000_100)  # rewritten
    (inbox / "n2.py").unlink()  # gone
    put(inbox, "n3.py", "import pandas\ndf = spark.table('main.raw.t3')\n", 1_700_000_200)  # touched only
    put(inbox, "old.py", "spark.table('main.raw.old')\n", 1_600_000_000)  # copied in with an old time
    changes.sync_folder(spark, str(inbox), "*.py", table, "run1")
    check()
    assert sinks.read_versions(spark, f"{table}/analysis").filter("path LIKE '%n3.py'").count() == 1
    history = {(r.table_name, r.withdrawn is None) for r in changes.ref_history(spark, table).collect()}
    assert {("main.raw.t1", False), ("main.raw.t2", False), ("main.raw.other", True), ("main.raw.t3", True)} <= history
    before = rows(changes.current(spark, table))
    changes.sync_folder(spark, str(inbox), "*.py", table, "run1")  # the name was used: nothing happens
    changes.sync_folder(spark, str(inbox), "*.py", table, "run2")  # nothing has changed
    put(inbox, "n2.py", "spark.table('main.raw.back')\n", 1_700_000_300)
    assert rows(changes.current(spark, table)) == before
    changes.sync_folder(spark, str(inbox), "*.py", table, "run3")
    check()


def test_changes_come_once_and_in_any_order(spark, tmp_path, rows):
    table, kind = str(tmp_path / "t"), "path string, version long, content string"

    def apply(batch, *versions):
        changes.apply_changes(spark.createDataFrame([*versions], kind), table, batch)

    apply("a", ("x.py", 2, "spark.table('a.b')"), ("x.py", 1, "spark.table('old.old')"), ("y.py", 1, None))
    apply("b", ("x.py", 1, "spark.table('late.late')"))
    assert rows(changes.read_refs(spark, table), "table_name") == [("a.b",)]
    apply("c", ("x.py", 3, None), ("z.py", 1, ""))
    assert changes.read_refs(spark, table).count() == 0 and rows(changes.read_analysis(spark, table), "path") == [("z.py",)]
    apply("d", ("x.py", 4, "spark.table('a.b')"))
    assert rows(changes.read_refs(spark, table), "table_name") == [("a.b",)]


# ---- repeats and rules -----------------------------------------------------------------------------------


def test_late_repeats_inside_the_bound_write_nothing(spark, tmp_path):
    path = str(tmp_path)
    for i, shift in enumerate((0, 120, 7200, 14400)):  # the third moves the watermark past the first
        frame = spark.range(50).selectExpr("concat('k', id) AS k", "id AS version", f"timestamp_seconds(1700000000 + id + {shift}) AS ts")
        frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = streams.table_stream(spark, f"{path}/in", "*.parquet", frame.schema)
        query = streams.upsert_stream(stream, f"{path}/t", ["k"], ["version"], f"{path}/cp", (["k", "version"], "ts", "10 minutes"))
        query.awaitTermination()
        n = sinks.read_versions(spark, f"{path}/t").count()
        assert n == (50 if i < 3 else 100)  # beyond the bound a row counts as new; the table stays the same
        assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 50
    assert sinks.read_table(spark, f"{path}/t").count() == 50


def test_a_changed_limit_holds_from_the_next_batch(spark, tmp_path):
    path = str(tmp_path)

    def limit(value):
        spark.createDataFrame([("a", value)], "tool_name string, limit long").write.mode("overwrite").parquet(f"{path}/rules")

    def more(start):
        frame = spark.range(6).selectExpr("id AS call_id", f"timestamp_seconds({start} + id) AS ts", "if(id < 4, 'a', 'b') AS tool_name")
        late = spark.createDataFrame([(9, start + 3600, "z")], "call_id long, s long, tool_name string").selectExpr("call_id", "timestamp_seconds(s) AS ts", "tool_name")
        frame.union(late).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = streams.table_stream(spark, f"{path}/in", "*.parquet", frame.schema)
        streams.ruled_breaches_stream(stream, f"{path}/rules", 1, f"{path}/t", f"{path}/cp").awaitTermination()
        return sorted((r.tool_name, r.n_calls, r.limit) for r in sinks.read_versions(spark, f"{path}/t").collect())

    limit(9)
    assert more(1_700_000_040) == [("b", 2, 1)]
    limit(3)
    assert more(1_700_010_000) == [("a", 4, 3), ("b", 2, 1), ("b", 2, 1)]


def test_only_a_short_lookup_is_broadcast(spark):
    def hinted(n):
        plan = skew.few_broadcast(spark.range(n), 10)._jdf.queryExecution().logical().toString()
        return "broadcast" in plan.lower()

    assert hinted(10) and not hinted(11)


# ---- running totals and long texts -------------------------------------------------------------------------


def test_running_totals_over_a_hot_group(spark):
    frame = spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', concat('g', id % 7)) AS g", "5000 - id AS o", "id % 13 AS v").repartition(7)
    got = {(r.g, r.o): r._before for r in running.before_each(frame, ["g"], ["o"], F.col("v")).collect()}
    sums = {}
    for r in sorted(frame.collect(), key=lambda r: r.o):
        assert got[r.g, r.o] == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + r.v
    assert len(got) == 5000


def test_chunks_of_a_turn_are_its_reply(spark):
    rows = [("hot", 0, i, "assistant", "text", None, None, ("é" * (i % 31)) + str(i), None) for i in range(900)]
    rows += [("big", 1, 0, "assistant", "text", None, None, "ab" * 5000, None), ("big", 1, 1, "assistant", "text", None, None, None, None)]
    rows += [("none", 0, 0, "assistant", "text", None, None, "", None), ("user", 0, 0, "user", "text", None, None, "no reply", None)]
    chunks = agentlog.turn_text(spark.createDataFrame(rows, SCHEMA).repartition(5), 100).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        whole.setdefault((r.session_id, r.turn_id), []).append(r.text)
    assert {k: "".join(v) for k, v in whole.items()} == {("hot", 0): "".join(r[7] for r in rows[:900]), ("big", 1): "ab" * 5000}
    assert all(len(t) == 100 for v in whole.values() for t in v[:-1])
    assert agentlog.turn_text(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- nested statements ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("content", "want"), [
    ("CREATE PROCEDURE p() BEGIN SELECT 1; IF a THEN DELETE FROM t; END IF; END; SELECT 2",
     ["CREATE PROCEDURE p() BEGIN SELECT 1; IF a THEN DELETE FROM t; END IF; END; ", "SELECT 2"]),
    ("create function f() begin case x when 1 then select 1; end case; end;\nselect case when a then 1 end;",
     ["create function f() begin case x when 1 then select 1; end case; end;\n", "select case when a then 1 end;"]),
    ("CREATE PROCEDURE q() DECLARE x INT; y INT; BEGIN BEGIN SELECT 1; END; END; SELECT 3",
     ["CREATE PROCEDURE q() DECLARE x INT; y INT; BEGIN BEGIN SELECT 1; END; END; ", "SELECT 3"]),
    ("BEGIN; SELECT 1; COMMIT", ["BEGIN; ", "SELECT 1; ", "COMMIT"]),
    ("BEGIN TRANSACTION; UPDATE t SET a = 1; END; SELECT 1", ["BEGIN TRANSACTION; ", "UPDATE t SET a = 1; ", "END; ", "SELECT 1"]),
    ("CREATE F AS $x$ SELECT 1; BEGIN $x$; SELECT $$a;b$$; SELECT '$$'", ["CREATE F AS $x$ SELECT 1; BEGIN $x$; ", "SELECT $$a;b$$; ", "SELECT '$$'"]),
    ("SELECT begin FROM t; SELECT 'BEGIN'; -- BEGIN;\nSELECT 2", ["SELECT begin FROM t; ", "SELECT 'BEGIN'; -- BEGIN;\n", "SELECT 2"]),
    ("CREATE PROCEDURE open() BEGIN SELECT 1; SELECT 2", ["CREATE PROCEDURE open() BEGIN SELECT 1; SELECT 2"]),
    ("BEGIN", ["BEGIN"]), (" ; ", [" ; "]), ("", []), ("SELECT 1$; SELECT $2", ["SELECT 1$; ", "SELECT $2"]),
])
def test_blocks_are_one_statement(spark, content, want):
    frame = spark.createDataFrame([(content,)], "content string")
    assert frame.select(statements.statement_list(F.col("content"))).first()[0] == want


def test_a_long_script_of_blocks(spark):
    one = "CREATE PROCEDURE p() BEGIN SELECT 1; SELECT CASE WHEN a THEN 1 END; END;\nSELECT 2;\n"
    frame = spark.createDataFrame([(one * 1500,)], "content string")
    got = frame.select(statements.statement_list(F.col("content"))).first()[0]
    assert len(got) == 3000 and "".join(got) == one * 1500


# ---- named files, lookups, tables -----------------------------------------------------------------------------


def test_files_have_their_own_names(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    blocks = spark.createDataFrame([("b1", i, f"{i:03d}", f"line {i} é\n") for i in range(200)] + [("b2", 0, "", None), ("b2", 1, "", "only")],
                                   "bundle_name string, section long, sort_key string, text string").repartition(5)
    readme = sinks.readme_blocks(blocks.select("bundle_name").distinct())
    write_bundle_files(blocks, str(out))
    write_bundle_files(readme, str(out))  # other names beside them
    assert (out / "b1" / "databricks.yml").read_text() == "".join(f"line {i} é\n" for i in range(200))
    assert (out / "b2" / "databricks.yml").read_text() == "only" and (out / "b2" / "README.md").read_text().startswith("# b2\n")
    with pytest.raises(PySparkException):
        write_bundle_files(blocks, str(out))
    write_bundle_files(blocks.filter("bundle_name = 'b2'").withColumn("text", F.lit("new")), str(out), overwrite=True)
    assert (out / "b2" / "databricks.yml").read_text() == "newnew" and (out / "b1" / "databricks.yml").exists()
    assert sorted(p.name for p in out.iterdir()) == ["b1", "b2"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    blocks = spark.createDataFrame([("ok", 0, "", "x"), ("../bad", 0, "", "x")], "bundle_name string, section long, sort_key string, text string")
    (tmp_path / "out").mkdir()
    with pytest.raises(PySparkException):
        write_bundle_files(blocks.coalesce(1), str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def scanned(frame):
    """Rows that the scan of a collected frame has put out."""
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan)
    return sum(found)


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.range(0, 400_000, 2).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS v")
    keyed.write_keyed(rows.repartition(4), path, "k", 1 << 18)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    hit = keyed.lookup(spark, path, "k", 123_456)
    assert [r.k for r in hit.collect()] == [123_456] and 0 < scanned(keyed.lookup(spark, path, "k", 123_456)) <= 20_000
    assert scanned(keyed.lookup(spark, path, "k", 123_457)) == 0  # inside the range of a group, but not in its Bloom filter


def test_a_created_table_is_joined_in_place(spark, tmp_path):
    transactions = spark.range(1000).selectExpr("id AS transaction_id", "id % 50 AS customer_id", "cast(id AS double) AS amount", "date'2024-01-01' AS transaction_date")
    customers = spark.range(50).selectExpr("id", "concat('c', id) AS customer_name")
    table = workloads.create_customer_metrics(spark, transactions, customers, "2023-01-01", "metrics_of_test", str(tmp_path / "m"), 8)
    try:
        assert table.count() == 50
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = table.join(spark.table("metrics_of_test").groupBy("customer_id").count(), "customer_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        again = workloads.create_customer_metrics(spark, transactions.filter("customer_id < 3"), customers, "2023-01-01", "metrics_of_test", str(tmp_path / "m"), 8)
        assert again.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE metrics_of_test")


def test_rows_and_count_are_of_one_execution(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("ten")
    query = "SELECT id, rand() AS r FROM ten WHERE rand() < 0.5"  # another run would count others
    n = src.run_sql_counted(spark, query, str(tmp_path / "out"))
    assert n == spark.read.text(str(tmp_path / "out")).count()
    assert src.run_sql_counted(spark, "SELECT * FROM ten WHERE id > :low", str(tmp_path / "none"), {"low": 99}) == 0


def test_failed_validations_have_a_whole_row(spark):
    row = config.validation_failures(spark.createDataFrame([(1, "gone")], "run_id long, error string")).first()
    assert not row.validation_passed and row.errors == ["gone"] and row.validation_summary.total_errors == 1
    assert row.security_checks.issues == ["gone"] and row.recommendations.next_steps == ["Fix the error and try again"]
