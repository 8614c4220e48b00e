"""Agent-log, evaluation and test-result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeharbor.catalog.configs import joined
from codeharbor.catalog.views import over, text, text_list
from codeharbor.functions import rules, tools
from codeharbor.functions import text as tx
from codeharbor.operators import agentlog as log
from codeharbor.operators import evaluation as ev
from codeharbor.sources.assets import asset

QUERIES = {}
ORACLE = {}


def on(views, name, sql, fn, *ctes):
    views = [views] if isinstance(views, str) else views
    QUERIES[name] = lambda spark, sf_dir: fn(*[asset(spark, sf_dir, v) for v in views])
    if sql is not None:
        ORACLE[name] = over(sql, *views, *ctes)


CLEAN = "regexp_replace(tool_name, '^(mcp__databricks-mcp__|mcp__databricks__)', '')"
SUBAGENT = "coalesce(json_extract_string(tool_input, '$.subagent_type'), 'unknown')"
CALLS = f"""calls AS MATERIALIZED (SELECT *, {CLEAN} AS tool,
  CASE WHEN tool_name = 'Task' THEN 'subagent:' || {SUBAGENT} ELSE {CLEAN} END AS label
  FROM messages WHERE block_type = 'tool_use')"""
YAML = r"""trim(list_extract(list_filter(regexp_extract_all(text, '(?s)```(?:yaml|yml)?\s*\n(.*?)```', 1),
  lambda b: contains(b, 'bundle:') OR contains(b, 'resources:')), 1), ' ' || chr(10) || chr(9) || chr(13))"""
REPLY = "msg_type = 'assistant' AND block_type = 'text'"
CONFIGS = f"configs_said AS MATERIALIZED (SELECT *, CASE WHEN {REPLY} THEN {YAML} END AS config FROM messages)"


def among(mode):
    return f"list_contains({text_list(rules.DESTRUCTIVE_TOOLS[mode])}, tool)"


on("messages", "j5_destructive_calls", f"SELECT session_id, seq, tool FROM calls WHERE {among('mcp')}",
   log.destructive_calls, CALLS)
on("messages", "j5_destructive_calls_sdk", f"SELECT session_id, seq, tool FROM calls WHERE {among('sdk')}",
   lambda m: log.destructive_calls(m, "sdk"), CALLS)
on("messages", "j5_auto_approved_calls", f"SELECT session_id, seq, tool FROM calls WHERE NOT {among('mcp')}",
   log.auto_approved_calls, CALLS)
REGISTRY = ", ".join(f"({text(group)}, {text(tool)})" for group, members in tools.GROUPS.items() for tool in members)
on("messages", "j6_calls_by_category", """SELECT tool_group, count(*) AS n_calls FROM calls JOIN registry USING (tool)
  GROUP BY ALL""", log.calls_by_category, CALLS, f"registry(tool_group, tool) AS (VALUES {REGISTRY})")
on("messages", "w7_tool_names", "SELECT DISTINCT tool FROM calls ORDER BY tool", log.tool_names, CALLS)
on("messages", "f2_clean_tool", "SELECT session_id, seq, tool FROM calls",
   lambda m: log.calls(m), CALLS)
on("messages", "f3_subagent", f"""SELECT session_id, seq, {SUBAGENT} AS subagent_type,
  coalesce(json_extract_string(tool_input, '$.description'), '') AS description FROM calls WHERE tool_name = 'Task'""",
   log.subagent_calls, CALLS)
on("messages", "f4_cost_text", """SELECT session_id, seq, CASE WHEN cost <> 0 THEN printf('$%.4f', cost) END AS cost_text
  FROM messages WHERE cost IS NOT NULL""",
   lambda m: m.filter("cost IS NOT NULL").select("session_id", "seq", tx.cost_text(F.col("cost")).alias("cost_text")))
on("messages", "w6_tool_inputs", """SELECT session_id, seq, label, CASE WHEN len(tool_input) > 80
  THEN substring(tool_input, 1, 80) || '...' ELSE tool_input END AS short_input FROM calls""", lambda m: log.tool_inputs(m, 80), CALLS)
on("messages", "l21_extract_yaml", "SELECT session_id, seq, config FROM configs_said WHERE config IS NOT NULL",
   log.extracted_configs, CONFIGS)
WORDS = ", ".join(f"({i}, {text(w)})" for i, w in enumerate(rules.LANGUAGE_WORDS))
on("messages", "l22_keyword_hits", f"""SELECT session_id, word,
    row_number() OVER (PARTITION BY session_id ORDER BY min(seq), place) AS rank
  FROM messages JOIN words ON contains(text, word) WHERE {REPLY} GROUP BY session_id, word, place""",
   lambda m: log.keyword_hits(m, rules.LANGUAGE_WORDS), f"words(place, word) AS (VALUES {WORDS})")
on("messages", "a7_session_tools", "SELECT session_id, turn_id, seq, label FROM calls", log.session_tools, CALLS)
on("messages", "a7_session_summary", """SELECT session_id, count(*) FILTER (block_type = 'tool_use') AS n_tools,
    count(*) FILTER (block_type = 'tool_result' AND tool_name LIKE '%analyze_notebook') AS n_analyzed,
    substring(arg_max(text, seq) FILTER (block_type = 'tool_result' AND tool_name LIKE '%validate_bundle' AND text <> ''), 1, 400)
      AS validation_summary FROM messages GROUP BY session_id""", lambda m: log.session_summary(m, 400))
on("messages", "a8_session_text", f"SELECT session_id, turn_id, seq, text FROM messages WHERE {REPLY}", log.session_text)
on("messages", "a8_t2_turn_rollup", """SELECT session_id, turn_id, count(*) AS n_messages,
    count(*) FILTER (block_type = 'tool_use') AS n_tools, bool_or(msg_type = 'result') AS done,
    arg_max(cost, seq) FILTER (cost IS NOT NULL) AS last_cost,
    arg_max(config, seq) FILTER (config IS NOT NULL) AS last_config FROM configs_said GROUP BY ALL""",
   log.turn_rollup, CONFIGS)
on("messages", "a10_message_types", """SELECT session_id, string_agg(DISTINCT msg_type, '|' ORDER BY msg_type) AS message_types
  FROM messages GROUP BY session_id""", lambda m: log.message_types(m).withColumn("message_types", joined("message_types")))

# ---- evaluation ------------------------------------------------------------------------------------

CHECK = """CASE WHEN actual IS NULL OR actual = '' THEN false
  ELSE contains(lower(trim(actual)), lower(trim(expected)))
    OR coalesce(TRY_CAST(trim(actual) AS DOUBLE) = TRY_CAST(trim(expected) AS DOUBLE), false) END"""
SCORED = f"scored AS MATERIALIZED (SELECT *, {CHECK} AS correct FROM qa)"
on("qa", "c13_check_answer", "SELECT qa_id, expected, actual, correct FROM scored",
   lambda q: ev.scored(q).select("qa_id", "expected", "actual", "correct"), SCORED)
ACCURACY = """count(*) AS total, count(*) FILTER (correct) AS correct,
  round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 6) AS accuracy,
  count(*) FILTER (correct) * 100.0::DOUBLE / count(*) >= 80 AS passed"""
on("qa", "c14_accuracy", f"SELECT {ACCURACY} FROM scored",
   lambda q: ev.accuracy(q).withColumn("accuracy", F.round("accuracy", 6)), SCORED)
on("qa", "c14_accuracy_by_complexity", f"SELECT complexity, tools_needed, {ACCURACY} FROM scored GROUP BY ALL",
   lambda q: ev.accuracy(q, "complexity", "tools_needed").withColumn("accuracy", F.round("accuracy", 6)), SCORED)
on("qa", "p8_placeholder_rows", "SELECT qa_id, question FROM qa WHERE contains(expected, 'UPDATE_WITH')",
   lambda q: ev.placeholder_rows(q).select("qa_id", "question"))
on("qa", "p8_placeholder_preview", """SELECT qa_id, substring(question, 1, 50) AS question FROM qa
  WHERE contains(expected, 'UPDATE_WITH') ORDER BY qa_id LIMIT 3""", lambda q: ev.placeholder_preview(q, 3, 50))

# ---- test results and the call log -------------------------------------------------------------------

PASSED = "(exception IS NULL AND success)"
on("test_results", "a6_test_rollup", f"""SELECT suite, count(*) FILTER {PASSED} AS tests_passed,
    count(*) FILTER (NOT {PASSED}) AS tests_failed, count(*) AS total_tests, bool_and({PASSED}) AS success
  FROM test_results GROUP BY suite""", log.test_rollup)
on("test_results", "a6_test_errors", f"""SELECT suite, test_no, 'Test ' || test_no || CASE WHEN exception IS NOT NULL
    THEN ' failed with exception: ' || exception ELSE ' failed: ' || coalesce(error, 'Unknown error') END AS error
  FROM test_results WHERE NOT {PASSED}""", log.test_errors)


def stamped(frame, *columns):
    """Timestamps as text, so both engines print them alike."""
    return frame.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
GAPS = f"""SELECT session_id, strftime(min(ts), {STAMP}) AS session_start,
    strftime(max(ts) + INTERVAL 30 MINUTE, {STAMP}) AS session_end, count(*) AS n_calls FROM (
    SELECT *, sum(is_new) OVER (PARTITION BY session_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, call_id) < INTERVAL 30 MINUTE
        THEN 0 ELSE 1 END AS is_new FROM tool_calls)) GROUP BY session_id, run"""
on("tool_calls", "t3_session_gaps", GAPS, lambda c: stamped(log.session_gaps(c), "session_start", "session_end"))
on("tool_calls", "t4_calls_per_minute", f"""SELECT tool_name, strftime(date_trunc('minute', ts), {STAMP}) AS window_start,
  count(*) AS n_calls FROM tool_calls GROUP BY ALL""", lambda c: stamped(log.calls_per_window(c), "window_start"))
LIMIT = " ".join(f"WHEN {text(t)} THEN {n}" for t, n in rules.RATE_LIMITS.items())
on("tool_calls", "t4_rate_breaches", f"""SELECT tool_name, strftime(window_start, {STAMP}) AS window_start, n_calls, limit_ AS "limit"
  FROM (SELECT tool_name, date_trunc('day', ts) AS window_start, count(*) AS n_calls,
    CAST(CASE tool_name {LIMIT} ELSE {rules.DEFAULT_RATE_LIMIT} END AS BIGINT) AS limit_ FROM tool_calls GROUP BY ALL)
  WHERE n_calls > limit_""",
   lambda c: stamped(log.rate_breaches(c, tools.rate_limit(F.col("tool_name")), "1 day"), "window_start"))
