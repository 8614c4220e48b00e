"""Sources and sinks round trips; streams against their batch twins."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeharbor.functions import tools
from codeharbor.operators import agentlog, evaluation, extraction, lineage
from codeharbor.plans import analysis
from codeharbor.sources import files as src
from codeharbor.sources import sinks
from codeharbor.streaming import streams

from test_agents import MESSAGES, SCHEMA


def test_read_files(spark, tmp_path):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "a" / "one.py").write_text("import os\nx = 1\n")
    (tmp_path / "a" / "b c" / "t+w é.sql").write_text("select 1\r\n\n")
    (tmp_path / "a" / "skip.txt").write_text("no")
    got = {r.path: r for r in src.read_files(spark, str(tmp_path), "*.{py,sql}").collect()}
    assert {p: r.content for p, r in got.items()} == {
        str(tmp_path / "a" / "one.py"): "import os\nx = 1\n", str(tmp_path / "a" / "b c" / "t+w é.sql"): "select 1\r\n\n"}
    listing = src.storage_listing(spark, str(tmp_path))
    assert {(r.path, r.file_size) for r in listing.collect()} >= {(str(tmp_path / "a" / "skip.txt"), 2)}
    names = {r[0] for r in lineage.relative_files(listing, str(tmp_path)).collect()}
    assert names == {"a/one.py", "a/b c/t+w é.sql", "a/skip.txt"}


def test_read_sources_prefers_local(spark, rows):
    def frame(*pairs):
        return spark.createDataFrame(list(pairs), "path string, content string")

    encoded = __import__("base64").b64encode("é = 1".encode()).decode()
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    got = rows(src.read_sources(wanted, frame(("a", "local")), frame(("a", encoded), ("b", encoded), ("d", "not base64!"))))
    assert got == [("a", "local", None), ("b", "é = 1", None), ("c", None, "File not found: c"), ("d", "not base64!", None)]


def test_decode_export(spark, rows):
    frame = spark.createDataFrame([("aGk=",), ("plain text!",), ("/w==",), ("",)], "content string")
    assert rows(lineage.decode_export(frame)) == sorted([("hi",), ("plain text!",), ("/w==",), ("",)], key=repr)
    assert rows(lineage.decode_export(frame, fmt="html")) == rows(frame)
    with pytest.raises(ValueError):
        lineage.decode_export(frame, fmt="PDF")


def test_write_bundles(spark, tmp_path):
    blocks = spark.createDataFrame(
        [("b1", i, f"{i:03d}", f"line {i}\n") for i in range(40)] + [("b2", 0, "", "only")],
        "bundle_name string, section long, sort_key string, text string")
    out = str(tmp_path / "out")
    sinks.write_bundles(blocks, out)
    folder = tmp_path / "out" / "bundle_name=b1" / "file=databricks.yml"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*.txt")))
    assert text == "".join(f"line {i}\n" for i in range(40))
    with pytest.raises(AnalysisException):
        sinks.write_bundles(blocks, out)
    readme = sinks.readme_blocks(blocks.select("bundle_name").distinct())
    sinks.write_bundles(blocks.withColumn("file", F.lit("databricks.yml")).unionByName(readme), out, overwrite=True)
    assert list((tmp_path / "out" / "bundle_name=b2" / "file=README.md").glob("part-*"))


def test_envelopes(spark):
    frame = spark.createDataFrame([(1, None), (2, "bad")], "x int, error string")
    good, bad = [json.loads(r.response) for r in sinks.to_envelope(frame).collect()]
    assert good["success"] and good["data"] == {"x": 1} and "timestamp" in good
    assert bad["error"] == "bad" and not bad["success"] and "data" not in bad
    inner = [json.loads(json.loads(r.response)["content"][0]["text"]) for r in sinks.to_envelope(frame, "sdk").collect()]
    assert inner == [{"x": 1}, {"error": "bad"}]


def test_qa_and_results(spark, tmp_path, rows):
    (tmp_path / "qa.xml").write_text(
        "<evaluation><!-- x --><qa_pair><question> How many? </question><answer>007</answer>"
        "<tools_needed>list_jobs</tools_needed><complexity>simple</complexity></qa_pair>"
        "<qa_pair><question>Which?</question><answer> UPDATE_WITH_ID </answer></qa_pair></evaluation>")
    qa = src.read_qa(spark, str(tmp_path / "qa.xml"))
    assert rows(qa) == [("How many?", "007", "list_jobs", "simple"), ("Which?", "UPDATE_WITH_ID", "", "unknown")]
    assert evaluation.placeholder_rows(qa).count() == 1
    scored = evaluation.scored(qa.withColumn("actual", F.lit("7")))
    sinks.write_results(evaluation.accuracy(qa.withColumn("actual", F.lit("7"))), scored, str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res" / "summary")).first().correct == 1


def test_run_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    got = [json.loads(r.row) for r in src.run_sql(spark, "SELECT id, null AS n FROM three WHERE id >= :a", {"a": 1}).collect()]
    assert got == [{"id": "1", "n": None}, {"id": "2", "n": None}]
    assert src.run_sql(spark, "SELECT * FROM three WHERE id > 9").count() == 0


# ---- keyed tables -----------------------------------------------------------------------------------


def change(spark, *values):
    return spark.createDataFrame(list(values), "k string, version long, v string")


def test_upsert_table_is_repeatable(spark, tmp_path, rows):
    table = str(tmp_path / "t")
    sinks.upsert_table(change(spark, ("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")), table, ["k"], ["version"], "b0")
    assert rows(sinks.read_table(spark, table)) == [("a", 2, "y"), ("b", 1, "x")]
    for _ in range(2):  # the second time stands for a repeated batch
        sinks.upsert_table(change(spark, ("a", 1, "old"), ("c", 1, "z")), table, ["k"], ["version"], "b1")
        assert rows(sinks.read_table(spark, table)) == [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "z")]
    sinks.upsert_table(change(spark, ("q", 1, "x")).limit(0), table, ["k"], ["version"], "b2")
    assert sinks.read_table(spark, table).count() == 3
    with pytest.raises(ValueError, match="other keys"):
        sinks.upsert_table(change(spark), table, ["v"], ["version"], "b3")


def test_compaction_keeps_the_rows(spark, tmp_path, rows):
    table = str(tmp_path / "t")
    for i in range(4):
        sinks.upsert_table(change(spark, ("a", i, f"v{i}"), (f"k{i}", 1, "x")), table, ["k"], ["version"], f"b{i}")
    want = rows(sinks.read_table(spark, table))
    sinks.compact(spark, table)
    assert rows(sinks.read_table(spark, table)) == want and len(sinks.committed(spark, table)) == 1
    sinks.upsert_table(change(spark, ("a", 9, "late")), table, ["k"], ["version"], "b9")
    sinks.upsert_table(change(spark, ("a", 99, "again")), table, ["k"], ["version"], "b1")  # taken in before
    assert ("a", 9, "late") in rows(sinks.read_table(spark, table)) and sinks.read_versions(spark, table).count() == 6


def test_upsert_table_after_a_crash(spark, tmp_path, rows):
    """A batch whose files were written but never committed does not count and is written anew."""
    table = str(tmp_path / "t")
    sinks.upsert_table(change(spark, ("a", 1, "x")), table, ["k"], ["version"], "b0")
    change(spark, ("z", 1, "half")).write.parquet(f"{table}/versions/b1")
    assert rows(sinks.read_table(spark, table)) == [("a", 1, "x")]
    sinks.upsert_table(change(spark, ("b", 1, "y")), table, ["k"], ["version"], "b1")
    assert rows(sinks.read_table(spark, table)) == [("a", 1, "x"), ("b", 1, "y")]


def test_a_new_checkpoint_on_an_old_table_loses_nothing(spark, tmp_path, rows):
    table, schema = str(tmp_path / "t"), "k string, version long, v string"
    for i in range(2):  # another stream each time, whose batches are numbered from 0 again
        change(spark, ("a", i, f"v{i}"), (f"k{i}", 1, "x")).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}"))
        streams.upsert_stream(stream, table, ["k"], ["version"], str(tmp_path / f"cp{i}")).awaitTermination()
    assert rows(sinks.read_table(spark, table)) == [("a", 1, "v1"), ("k0", 1, "x"), ("k1", 1, "x")]


def test_wide_write_has_a_folder_per_value(spark, tmp_path, rows):
    from codeharbor.operators import workloads

    frame = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 7 END AS k")
    workloads.write_wide(frame, str(tmp_path / "w"), "k")
    assert {p.name for p in (tmp_path / "w").iterdir() if p.is_dir()} == {"k=hot", *(f"k=k{i}" for i in range(7))}
    assert rows(spark.read.parquet(str(tmp_path / "w")), "id", "k") == rows(frame, "id", "k")


# ---- streams ------------------------------------------------------------------------------------------


def test_analysis_stream_equals_batch(spark, tmp_path, rows):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(6):
        (inbox / f"n{i}.py").write_text(f"import pandas\ndf = spark.table('main.raw.t{i % 2}')\ndf.write.saveAsTable('a.b{i}')\n")
    stream = streams.file_stream(spark, str(inbox), "*.py", per_trigger=2)
    streams.append_stream(streams.table_refs_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = extraction.table_refs(src.read_files(spark, str(inbox), "*.py"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    wide = streams.analyze_stream(streams.file_stream(spark, str(inbox), "*.py"))
    streams.append_stream(wide, str(tmp_path / "wide"), str(tmp_path / "cp2")).awaitTermination()
    again = analysis.analyze(src.read_files(spark, str(inbox), "*.py"))
    columns = ["path", "file_type", "workflow_type", "input_tables", "modules"]
    assert rows(spark.read.parquet(str(tmp_path / "wide")), *columns) == rows(again, *columns)
    (inbox / "late.py").write_text("spark.table('c.d')")
    streams.append_stream(streams.table_refs_stream(streams.file_stream(spark, str(inbox), "*.py")),
                          str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("table_name = 'c.d'").count() == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() + 1


def messages_in_files(spark, path):
    """The messages, out of order, over several files."""
    frame = spark.createDataFrame(MESSAGES, SCHEMA).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 10))
    for part in (2, 0, 1):
        frame.filter(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    return frame


def test_turn_stream_equals_batch(spark, tmp_path, rows):
    frame = messages_in_files(spark, str(tmp_path / "in"))
    stream = streams.table_stream(spark, str(tmp_path / "in"), "*.parquet", frame.schema, per_trigger=1)
    query = streams.turns_stream(stream, str(tmp_path / "turns"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert rows(streams.read_turns(spark, str(tmp_path / "turns"))) == rows(agentlog.turn_rollup(frame))


def calls_in_files(spark, path):
    minutes = [0, 1, 2, 40, 41, 120, 121, 300, 1000]
    frame = spark.createDataFrame([(i, i % 2, m) for i, m in enumerate(minutes * 3)], "call_id long, session_id long, m long")
    frame = frame.select("call_id", "session_id", F.timestamp_seconds(F.lit(1_700_000_040) + F.col("m") * 60).alias("ts"),
                         F.lit("execute_dbsql").alias("tool_name"))
    frame.orderBy("ts").coalesce(1).write.parquet(path)
    return frame


def test_session_and_rate_streams_equal_batch_for_closed_windows(spark, tmp_path, rows):
    frame = calls_in_files(spark, str(tmp_path / "in"))

    def stream():
        return streams.table_stream(spark, str(tmp_path / "in"), "*.parquet", frame.schema)

    streams.append_stream(streams.session_gaps_stream(stream()), str(tmp_path / "gaps"), str(tmp_path / "cp1")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "gaps")))
    last = frame.agg(F.max("ts")).first()[0]
    closed = agentlog.session_gaps(frame).filter(F.col("session_end") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    assert got == rows(closed) and len(got) > 4
    limit = F.lit(2).cast("long")
    streams.append_stream(streams.rate_breaches_stream(stream(), limit), str(tmp_path / "rate"), str(tmp_path / "cp2")).awaitTermination()
    batch = agentlog.rate_breaches(frame, limit).filter(
        F.col("window_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    assert rows(spark.read.parquet(str(tmp_path / "rate"))) == rows(batch) and batch.count() == 8
    assert tools.rate_limit(F.lit("x")) is not None
