"""Message roll-ups and answer scoring."""

import pytest
from pyspark.sql import functions as F

from codeharbor.functions import tools
from codeharbor.operators import agentlog as log
from codeharbor.operators import evaluation as ev

MESSAGES = [
    # session, turn, seq, type, block, tool, input, text, cost
    ("s", 0, 0, "system", "text", None, None, "hello", None),
    ("s", 0, 1, "assistant", "text", None, None, "Go. ```yaml\nbundle: 1\n```", None),
    ("s", 0, 2, "assistant", "tool_use", "mcp__databricks-mcp__run_job", '{"a": 1}', None, None),
    ("s", 0, 3, "assistant", "tool_use", "Task", '{"subagent_type": "analyst"}', None, None),
    ("s", 0, 4, "user", "tool_result", "mcp__databricks-mcp__validate_bundle", None, "v" * 500, None),
    ("s", 0, 5, "assistant", "text", None, None, "Java", None),
    ("s", 0, 6, "result", "result", None, None, None, 0.5),
    ("s", 1, 7, "assistant", "tool_use", "mcp__databricks__execute_dbsql", None, None, None),
    ("s", 1, 8, "user", "tool_result", "mcp__databricks-mcp__validate_bundle", None, "", None),
    ("s", 1, 9, "user", "tool_result", "x_analyze_notebook", None, "fine", None),
    ("s", 1, 10, "assistant", "text", None, None, "```\nresources: 2\n``` JavaScript", None),
    ("t", 0, 0, "assistant", "tool_use", "Task", None, None, None),
    ("t", 0, 1, "assistant", "tool_use", "Read", None, None, None),
]
SCHEMA = ("session_id string, turn_id long, seq long, msg_type string, block_type string, tool_name string, "
          "tool_input string, text string, cost double")


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES[::-1], SCHEMA)


def test_audit(messages, rows):
    assert rows(log.destructive_calls(messages), "tool") == [("run_job",)]
    assert rows(log.destructive_calls(messages, "sdk"), "tool") == [("execute_dbsql",), ("run_job",)]
    assert log.auto_approved_calls(messages).count() == 4
    assert dict(rows(log.calls_by_category(messages))) == {"core": 2, "agent:analyst": 1, "agent:builder": 1}


def test_tool_lists_in_order(messages):
    said = log.session_tools(messages).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.turn_id, r.label) for r in said] == [
        ("s", 0, "run_job"), ("s", 0, "subagent:analyst"), ("s", 1, "execute_dbsql"), ("t", 0, "subagent:unknown"), ("t", 0, "Read")]
    text = log.session_text(messages).filter("session_id = 's' AND turn_id = 0").orderBy("seq").collect()
    assert "".join(r.text for r in text) == "Go. ```yaml\nbundle: 1\n```Java"


def test_partial_turns_merge_to_the_whole(messages, rows):
    parts = [log.turn_partials(messages.filter(F.col("seq") % 3 == k)) for k in range(3)]
    merged = log.merge_turns(parts[0].union(parts[1]).union(parts[2]))
    assert rows(merged) == rows(log.turn_rollup(messages))


def test_a_session_with_most_of_the_calls(spark, rows):
    import random

    pick = random.Random(2)
    calls = [(0 if i % 10 else i % 7, pick.randrange(0, 4_000_000)) for i in range(3000)] + [(9, 0), (9, 1800), (9, 3599), (9, 7200)]
    want = []
    for session in {s for s, _ in calls}:
        run = []
        for t in sorted(t for s, t in calls if s == session) + [None]:
            if run and (t is None or t - run[-1] >= 1800):
                want.append((session, run[0], run[-1] + 1800, len(run)))
                run = []
            run.append(t)
    frame = spark.createDataFrame(calls, "session_id long, t long").select("session_id", F.timestamp_seconds("t").alias("ts"))
    got = log.session_gaps(frame).select("session_id", F.unix_timestamp("session_start"), F.unix_timestamp("session_end"), "n_calls")
    assert rows(got) == sorted(want, key=repr)


def test_summary(messages):
    row = log.session_summary(messages, 400).filter("session_id = 's'").first()
    assert (row.n_tools, row.n_analyzed, row.validation_summary) == (3, 1, "v" * 400)
    types = {r.session_id: r.message_types for r in log.message_types(messages).collect()}
    assert types["s"] == ["assistant", "result", "system", "user"]


def test_turns(messages):
    got = {(r.session_id, r.turn_id): r for r in log.turn_rollup(messages).collect()}
    assert got["s", 0].done and got["s", 0].last_config == "bundle: 1" and got["s", 0].last_cost == 0.5
    assert not got["s", 1].done and got["s", 1].last_config == "resources: 2"


def test_keywords(messages):
    hits = log.keyword_hits(messages, ["Python", "JavaScript", "Java", "Go"]).orderBy("rank").collect()
    assert [h.word for h in hits] == ["Go", "Java", "JavaScript"]


def test_rate_limits(spark, rows):
    calls = spark.createDataFrame([(f"2024-01-01 00:00:{i:02d}", "execute_dbsql") for i in range(51)]
                                  + [("2024-01-01 00:01:00", "execute_dbsql")], "ts string, tool_name string")
    calls = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    got = log.rate_breaches(calls, tools.rate_limit(F.col("tool_name"))).collect()
    assert [(r.n_calls, r.limit) for r in got] == [(51, 50)]


def test_test_results(spark, rows):
    results = spark.createDataFrame(
        [("a", 0, True, None, None), ("a", 1, False, None, "bad"), ("a", 2, None, "boom", None), ("b", 0, True, None, None),
         ("a", 3, False, None, None)],
        "suite string, test_no long, success boolean, exception string, error string")
    assert rows(log.test_rollup(results)) == [("a", 1, 3, 4, False), ("b", 1, 0, 1, True)]
    assert rows(log.test_errors(results), "error") == [
        ("Test 1 failed: bad",), ("Test 2 failed with exception: boom",), ("Test 3 failed: Unknown error",)]


def test_answers(spark):
    cases = [
        ("5", "5", True), (" A ", "a", True), ("1", "10", True), ("5", "5.0", True), ("5.0", "5", True), ("5", "6", False),
        ("x", "", False), ("x", None, False), ("nan", "+nan", True), ("nan", "-Nan", True), ("1e2", "100", True),
        ("1_0", "10", True), ("1__0", "10", False), ("inf", "+Infinity", True), ("1d", "1.0", False), ("", "a", True),
        (".5", "0.5", True), ("5.", "5.00", True), ("abc", "the ABC of it", True), ("nan", "NAN!", True), ("- 5", "-5", False),
    ]
    frame = spark.createDataFrame(cases, "expected string, actual string, want boolean")
    got = ev.scored(frame).collect()
    assert [(r.expected, r.actual, r.correct) for r in got] == cases


def test_accuracy(spark):
    qa = spark.createDataFrame([("1", "1"), ("1", "1"), ("1", "1"), ("1", "1"), ("1", "2")], "expected string, actual string")
    row = ev.accuracy(qa).first()
    assert (row.total, row.correct, row.accuracy, row.passed) == (5, 4, 80.0, True)
    empty = ev.accuracy(qa.filter("expected = 'none'")).first()
    assert (empty.total, empty.correct, empty.accuracy, empty.passed) == (0, 0, 0.0, False)
