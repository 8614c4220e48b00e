"""Streams with state and changing files, whole turn texts, procedural SQL, named files, keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeharbor.catalog import files_extract as fx
from codeharbor.catalog import files_parse as fp
from codeharbor.catalog.agents import CALLS, CLEAN, CONFIGS, REPLY, STAMP, SUBAGENT, stamped
from codeharbor.catalog.pipes import scratch
from codeharbor.catalog.views import CUSTOMERS, FILES, over, text
from codeharbor.functions import rules, tools
from codeharbor.operators import agentlog, config, inventory, statements, workloads
from codeharbor.sources import files as src
from codeharbor.sources import keyed, sinks
from codeharbor.sources.assets import VIEWS, asset, customers
from codeharbor.sources.bundle_files import write_bundle_files
from codeharbor.sources.corpus import corpus_from, load
from codeharbor.streaming import changes, streams, turns

QUERIES = {}
ORACLE = {}


def _stream(spark, sf_dir, base):
    return streams.table_stream(spark, sf_dir, f"{base}.parquet", load(spark, sf_dir, base).schema)


# ---- T2: turns told once when they close ---------------------------------------------------------

LABEL = f"CASE WHEN tool_name = 'Task' THEN 'subagent:' || {SUBAGENT} ELSE tool END"
CONVERSATION_TS = "timestamp_seconds(1704067200 + conv_id * 600 + turn * 20) AS ts"


def _closed_turns(spark, sf_dir):
    told = None
    for base, ts in (("conversations", CONVERSATION_TS), ("events", "CAST(ts AS TIMESTAMP) AS ts")):
        rows = _stream(spark, sf_dir, base)
        parts = [rows.selectExpr(*expressions, ts) for b, expressions, _ in VIEWS["messages"] if b == base]
        messages = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = scratch(spark, "closed-turns")
        turns.start_stateful(turns.closed_turns(messages), out, scratch(spark, "closed-turns-state")).awaitTermination()
        part = spark.read.schema(turns.OUTPUT).parquet(out)
        told = part if told is None else told.unionByName(part)
    return told.withColumn("tools", F.array_join("tools", ","))


def _dated(base, ts):
    return " UNION ALL ".join(f"SELECT {', '.join(e)}, {ts} AS ts, '{base}' AS base FROM {base}" for b, e, _ in VIEWS["messages"] if b == base)


QUERIES["t2_closed_turns_stream"] = _closed_turns
ORACLE["t2_closed_turns_stream"] = f"""WITH messages AS MATERIALIZED (
  {_dated('conversations', "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn * 20)")}
  UNION ALL {_dated('events', 'ts')}),
labelled AS MATERIALIZED (SELECT *, epoch_ms(ts) AS ms, CASE WHEN block_type = 'tool_use' THEN {LABEL} END AS label FROM
  (SELECT *, {CLEAN} AS tool FROM messages)),
{CONFIGS.replace('FROM messages', 'FROM labelled')},
marks AS (SELECT base, max(ms) - 600000 AS passed FROM labelled GROUP BY base),
ends AS (SELECT session_id, turn_id, any_value(base) AS base, min(seq) FILTER (msg_type = 'result') AS last_seq,
    arg_min(ms, seq) FILTER (msg_type = 'result') AS result_ms, max(ms) AS last_ms FROM labelled GROUP BY session_id, turn_id),
closed AS (SELECT session_id, turn_id, last_seq FROM ends JOIN marks USING (base)
  WHERE coalesce(result_ms, last_ms + 3600000) <= passed),
said AS (SELECT m.*, last_seq FROM configs_said m JOIN closed USING (session_id, turn_id) WHERE coalesce(seq <= last_seq, true))
SELECT session_id, turn_id, CASE WHEN any_value(last_seq) IS NULL THEN 'timer' ELSE 'result' END AS closed_by, count(*) AS n_messages,
  coalesce(string_agg(label, ',' ORDER BY seq) FILTER (label IS NOT NULL), '') AS tools,
  coalesce(string_agg(text, '' ORDER BY seq) FILTER ({REPLY}), '') AS text,
  arg_max(config, seq) FILTER (config IS NOT NULL) AS last_config, arg_max(cost, seq) FILTER (cost IS NOT NULL) AS last_cost
FROM said GROUP BY session_id, turn_id"""

# ---- T1: files that change, and go -----------------------------------------------------------------

EDITED, GONE = "doc_id % 5 = 0", "doc_id % 7 = 3"


def _changed_files(spark, sf_dir):
    """Every file, then all of them again: some edited, some gone, the others as they were."""
    table = scratch(spark, "changed")
    for version in (1, 2):
        files = corpus_from(_stream(spark, sf_dir, "documents"))
        content = F.col("content")
        if version == 2:
            note = F.concat(F.lit("\n# spark.table('main.edited.t"), F.col("doc_id"), F.lit("')\n"))
            content = F.when(F.expr(f"NOT ({GONE})"), F.when(F.expr(EDITED), F.concat(content, note)).otherwise(content))
        versions = files.select("path", F.lit(version).cast("long").alias("version"), content.alias("content"))
        changes.changes_stream(versions, table, scratch(spark, "changed-state"), rules.FEATURE_LIMIT).awaitTermination()
    return table


EDITED_FILES = FILES.replace("files AS MATERIALIZED (", "old_files AS MATERIALIZED (") + f""",
files AS MATERIALIZED (SELECT path, CASE WHEN {EDITED} THEN content || chr(10) || '# spark.table(''main.edited.t' || doc_id || ''')'
    || chr(10) ELSE content END AS content, doc_id, lang, source, template FROM old_files WHERE NOT ({GONE}))"""


def _over_edited(sql, *ctes):
    return "WITH " + ",\n".join([EDITED_FILES, *ctes]) + "\n" + sql


QUERIES["t1_changed_refs_stream"] = lambda spark, sf_dir: changes.read_refs(spark, _changed_files(spark, sf_dir))
ORACLE["t1_changed_refs_stream"] = fx.ORACLE["l1_l2_l3_table_refs"].replace(FILES, EDITED_FILES)


def _history(spark, sf_dir):
    rows = changes.ref_history(spark, _changed_files(spark, sf_dir))
    return rows.groupBy("version", "withdrawn").agg(F.count("*").alias("n_refs"), F.countDistinct("path").alias("n_files"))


QUERIES["t1_ref_history_stream"] = _history
ORACLE["t1_ref_history_stream"] = _over_edited(f"""SELECT version, withdrawn, count(*) AS n_refs, count(DISTINCT path) AS n_files FROM (
    SELECT path, 1 AS version, CASE WHEN {EDITED} OR {GONE} THEN 2 END AS withdrawn FROM old_refs JOIN old_files USING (path)
    UNION ALL SELECT path, 2, NULL FROM refs JOIN files USING (path) WHERE {EDITED}) GROUP BY version, withdrawn""",
                                               fx.PYTHON_REFS, fx.PYTHON_REFS.replace("refs AS", "old_refs AS").replace("FROM files", "FROM old_files"))


def _told_analysis(spark, sf_dir):
    """The analysis of the files that stand, lists as text."""
    made = changes.read_analysis(spark, _changed_files(spark, sf_dir))

    def sorted_text(column):
        return F.array_join(F.array_sort(column), ",").alias(column)

    values = F.transform("features", lambda f: F.concat_ws("|", f["feature"], f["ordinal"], F.get(f["value"], 0), F.get(f["value"], 1)))
    params = F.transform("params", lambda p: F.concat_ws(":", p["widget_type"], p["name"], F.coalesce(p["default_value"], F.lit(""))))
    names = F.transform("definitions", lambda d: F.concat_ws(":", d["kind"], d["name"], d["lineno"].cast("string")))
    return made.select(
        "path", "version", "file_type", "size_chars", "workflow_type", F.array_join("stages", ",").alias("stages"),
        F.round("confidence", 6).alias("confidence"), *[sorted_text(c) for c in ("modules", "input_tables", "output_tables", "file_paths", "delta_tables")],
        F.array_join(F.array_sort(values), ",").alias("features"), F.array_join(params, ",").alias("params"),
        F.array_join(F.array_sort(names), ",").alias("definitions"), F.array_join("notebook_dependencies", ",").alias("notebook_dependencies"))


def _list_of(rows, value="v", order="v"):
    return f"(SELECT path, string_agg({value}, ',' ORDER BY {order}) AS l FROM ({rows}) GROUP BY path)"


_PY, _SQL = "file_type IN ('python', 'python_notebook')", "file_type IN ('sql', 'sql_notebook')"
_SQL_REFS = "(SELECT path, direction, table_name FROM gated UNION SELECT path, direction, table_name FROM sql_refs)"


def _tables(direction):
    return _list_of(f"""SELECT path, table_name AS v FROM refs JOIN typed USING (path) WHERE direction = '{direction}' AND {_PY}
      UNION ALL SELECT path, table_name FROM {_SQL_REFS} JOIN typed USING (path) WHERE direction = '{direction}' AND {_SQL}""")


_PARTS = {
    "modules": _list_of("SELECT path, module AS v FROM import_rows, range(n)"),
    "input_tables": _tables("input"), "output_tables": _tables("output"),
    "file_paths": _list_of(f"SELECT DISTINCT path, unnest({fx.found(rules.STORAGE_PATH)}) AS v FROM typed WHERE {_PY}"),
    "delta_tables": _list_of(f"SELECT DISTINCT path, unnest({fx.found(rules.DELTA_HANDLE, 0)}) AS v FROM typed WHERE {_PY}"),
    "features": _list_of("SELECT path, concat_ws('|', feature, ordinal::VARCHAR, value_1, value_2) AS v FROM feature_rows"),
    "params": "(SELECT path, params AS l FROM param_counts)",
    "definitions": _list_of(f"""SELECT path, kind || ':' || replace(replace(name, '{{src}}', source), '{{doc}}', doc_id::VARCHAR) || ':' || lineno AS v
      FROM files JOIN known_symbols USING (template)"""),
    "notebook_dependencies": _list_of(f"SELECT path, ordinal, callee AS v FROM ({fx.numbered(fx.found(rules.NOTEBOOK_CALL), 'callee')})", order="ordinal"),
}
QUERIES["t1_changed_analysis_stream"] = _told_analysis
ORACLE["t1_changed_analysis_stream"] = _over_edited(f"""SELECT path, CASE WHEN {EDITED} THEN 2 ELSE 1 END AS version, file_type, len(content) AS size_chars,
    workflow_type, array_to_string(stages, ',') AS stages, round(confidence, 6) AS confidence,
    {', '.join(f"coalesce({c}_of.l, '') AS {c}" for c in _PARTS)}
  FROM typed JOIN workflows USING (path) {' '.join(f"LEFT JOIN {rows} {c}_of USING (path)" for c, rows in _PARTS.items())}""",
    *fp.ON_ANALYSED, f"known_symbols(template, kind, name, args, lineno) AS (VALUES {fp.SYMBOL_ROWS})")

# ---- T5, T4, J6: repeats, rules as tables -----------------------------------------------------------


def _repeats(spark, sf_dir):
    """Every event comes twice, the second time some seconds later; the repeat would win by its number."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).filter("again = 0 OR event_id % 3 = 0")
    versions = twice.select(
        F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_type").alias("path"), F.col("event_id").alias("version"), F.md5("props").alias("digest"),
        (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, again * 30)")).alias("ts"))
    table = scratch(spark, "once")
    streams.upsert_stream(versions, table, ["path"], ["version"], scratch(spark, "once-state"), (["path", "version"], "ts", "10 minutes")).awaitTermination()
    written = sinks.read_versions(spark, table).groupBy("path").agg(F.count("*").alias("n_written"))
    return sinks.read_table(spark, table).select("path", "version", "digest").join(written, "path")


QUERIES["t5_repeats_stream"] = _repeats
ORACLE["t5_repeats_stream"] = """SELECT '/u' || user_id || '/' || event_type AS path, max(event_id) AS version,
  md5(arg_max(props, event_id)) AS digest, count(*) AS n_written FROM events GROUP BY user_id, event_type"""
LIMITS = {"export_notebook": 0, "run_job": 1}


def _ruled(spark, sf_dir):
    limits = scratch(spark, "limits")
    spark.createDataFrame([*LIMITS.items()], "tool_name string, limit long").write.parquet(limits)
    base, expressions, _ = VIEWS["tool_calls"][0]
    calls = _stream(spark, sf_dir, base).selectExpr(*expressions).withColumn("ts", F.col("ts").cast("timestamp"))
    table = scratch(spark, "ruled")
    streams.ruled_breaches_stream(calls, limits, 2, table, scratch(spark, "ruled-state"), "1 hour").awaitTermination()
    return stamped(sinks.read_versions(spark, table), "window_start")


QUERIES["t4_ruled_breaches_stream"] = _ruled
ORACLE["t4_ruled_breaches_stream"] = over(f"""SELECT tool_name, strftime(start, {STAMP}) AS window_start, n_calls,
    CASE tool_name {' '.join(f"WHEN {text(t)} THEN {n}" for t, n in LIMITS.items())} ELSE 2 END AS "limit"
  FROM (SELECT tool_name, date_trunc('hour', ts) AS start, count(*) AS n_calls FROM tool_calls GROUP BY tool_name, date_trunc('hour', ts))
  WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM tool_calls) - INTERVAL 10 MINUTE
    AND n_calls > CASE tool_name {' '.join(f"WHEN {text(t)} THEN {n}" for t, n in LIMITS.items())} ELSE 2 END""", "tool_calls")
REGISTRY = [(group, tool) for group, members in tools.GROUPS.items() for tool in members if group != "core"] + [("own", "run_job")]
QUERIES["j6_calls_by_registry"] = lambda spark, sf_dir: agentlog.calls_by_category(
    asset(spark, sf_dir, "messages"), spark.createDataFrame(REGISTRY, "tool_group string, tool string"))
ORACLE["j6_calls_by_registry"] = over("SELECT tool_group, count(*) AS n_calls FROM calls JOIN registry USING (tool) GROUP BY tool_group",
                                      "messages", CALLS, f"registry(tool_group, tool) AS (VALUES {', '.join(f'({text(g)}, {text(t)})' for g, t in REGISTRY)})")

# ---- A8: the whole reply of a turn --------------------------------------------------------------------

WIDTH = 1000
QUERIES["a8_turn_text"] = lambda spark, sf_dir: agentlog.turn_text(asset(spark, sf_dir, "messages"), WIDTH)
ORACLE["a8_turn_text"] = over(f"""SELECT session_id, turn_id, chunk_no, substring(whole, (chunk_no * {WIDTH} + 1)::BIGINT, {WIDTH}) AS text
  FROM (SELECT *, unnest(range((len(whole) + {WIDTH - 1}) // {WIDTH})) AS chunk_no FROM (
    SELECT session_id, turn_id, string_agg(text, '' ORDER BY seq) AS whole FROM messages WHERE {REPLY} GROUP BY session_id, turn_id))""", "messages")

# ---- L6, L5: procedural SQL --------------------------------------------------------------------------

#: type, and the statement with its semicolon as SQL that both engines read alike
PROCEDURAL = [
    ("CREATE", """'CREATE PROCEDURE main.p' || doc_id || '() BEGIN' || chr(10) || '  INSERT INTO main.t' || doc_id
      || ' SELECT CASE WHEN a > 1 THEN ''x; END'' ELSE ''y'' END FROM main.s' || doc_id || ';' || chr(10)
      || '  IF a = 1 THEN DELETE FROM main.u; END IF; CASE a WHEN 1 THEN SELECT 2; END CASE;' || chr(10) || 'END;'"""),
    ("SELECT", "'SELECT * FROM main.after' || doc_id || ';'"),
    ("CREATE", """'CREATE TABLE main.f' || doc_id || ' AS $body$ SELECT 1; ' || replace(text, chr(36), '') || '; $body$;'"""),
    ("UNKNOWN", "'BEGIN TRANSACTION;'"),
    ("UPDATE", "'UPDATE main.v SET a = 1;'"),
    ("UNKNOWN", "'COMMIT;'"),
    ("CREATE", "'CREATE FUNCTION main.g() DECLARE x INT; y INT; BEGIN BEGIN SELECT 1; END; RETURN x; END;'"),
    ("SELECT", "'SELECT ''' || source || ';'' FROM main.last' || doc_id"),
]


def _procedural(spark, sf_dir):
    content = " || chr(10) || ".join(s for _, s in PROCEDURAL)
    return load(spark, sf_dir, "documents").selectExpr("'/sql/p' || doc_id || '.sql' AS path", f"{content} AS content")


def _rows_of(column, cut):
    return " UNION ALL ".join(
        f"SELECT '/sql/p' || doc_id || '.sql' AS path, {i} AS stmt_no, '{kind}' AS stmt_type, {cut.format(s + (' || chr(10)' if i < len(PROCEDURAL) else ''))} AS {column} FROM documents"
        for i, (kind, s) in enumerate(PROCEDURAL, 1))


QUERIES["l6_procedural_statements"] = lambda spark, sf_dir: statements.sql_statements(_procedural(spark, sf_dir))
ORACLE["l6_procedural_statements"] = _rows_of("statement_prefix", "{0}")
QUERIES["l5_procedural_refs"] = lambda spark, sf_dir: statements.statement_refs(_procedural(spark, sf_dir)).filter("stmt_no <> 3")
ORACLE["l5_procedural_refs"] = """SELECT '/sql/p' || doc_id || '.sql' AS path, stmt_no, direction, name AS table_name FROM (
    SELECT doc_id, unnest([{'n': 1, 'd': 'output', 't': 'main.t' || doc_id}, {'n': 2, 'd': 'input', 't': 'main.after' || doc_id},
      {'n': 8, 'd': 'input', 't': 'main.last' || doc_id}]) AS r FROM documents), LATERAL (SELECT r.n AS stmt_no, r.d AS direction, r.t AS name)"""

# ---- S7, S8, P3, E7, S6, A2, G3 ---------------------------------------------------------------------


def _named_files(spark, sf_dir):
    out = scratch(spark, "named")
    blocks = asset(spark, sf_dir, "configs").select(
        F.regexp_extract("path", "bundles/([^/]*)", 1).alias("bundle_name"), F.lit(1).cast("long").alias("section"),
        F.col("path").alias("sort_key"), F.col("content").alias("text"))
    readme = sinks.readme_blocks(blocks.select("bundle_name").distinct())
    write_bundle_files(blocks.withColumn("file", F.lit(rules.CONFIG_FILE)).unionByName(readme), out)
    return src.read_files(spark, out).select(
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("bundle_name"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")


QUERIES["s7_s8_named_files"] = _named_files
ORACLE["s7_s8_named_files"] = over("""SELECT split_part(path, '/', 3) AS bundle_name, 'databricks.yml' AS file, content FROM configs
  UNION ALL SELECT split_part(path, '/', 3), 'README.md', '# ' || split_part(path, '/', 3) || chr(10) || chr(10) || '```bash' || chr(10)
    || 'databricks bundle validate' || chr(10) || 'databricks bundle deploy -t dev' || chr(10) || '```' || chr(10) FROM configs""", "configs")


def _lookup(spark, sf_dir):
    out = scratch(spark, "jobs")
    keyed.write_keyed(asset(spark, sf_dir, "jobs"), out, "job_id")
    found = [inventory.found_or_error(keyed.keyed(spark, out), "job_id", key, "job") for key in (7, -1)]
    return found[0].unionByName(found[1]).select("job_id", "name", "creator_user_name", "error")


QUERIES["p3_keyed_lookup"] = _lookup
ORACLE["p3_keyed_lookup"] = over("""SELECT job_id, name, creator_user_name, NULL AS error FROM jobs WHERE job_id = 7
  UNION ALL SELECT NULL, NULL, NULL, 'job 7 not found' WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE job_id = 7)
  UNION ALL SELECT NULL, NULL, NULL, 'job -1 not found'""", "jobs")


def _created(spark, sf_dir):
    name = f"customer_metrics_{uuid.uuid4().hex}"
    return workloads.create_customer_metrics(
        spark, asset(spark, sf_dir, "transactions"), customers(spark, sf_dir), "1995-01-01", name, scratch(spark, "metrics")
    ).select("customer_id", "transaction_count", F.round("total_spent", 2).alias("total_spent"), F.floor(F.col("avg_transaction") * 1000).alias("avg_transaction"))


QUERIES["e7_created_table"] = _created
ORACLE["e7_created_table"] = over(f"""SELECT customer_id, count(*) AS transaction_count, round(sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE, 2) AS total_spent,
    floor(sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE / count(amount) * 1000)::BIGINT AS avg_transaction
  FROM transactions JOIN customers ON customer_id = id WHERE transaction_date >= DATE '1995-01-01'
  GROUP BY customer_id HAVING count(amount) > 0""", "transactions", CUSTOMERS)


def _counted(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("codeharbor_counted")
    out = scratch(spark, "counted")
    n = src.run_sql_counted(spark, "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM codeharbor_counted GROUP BY ALL", out)
    return spark.read.text(out).select(F.col("value").alias("row"), F.lit(n).cast("long").alias("row_count"))


QUERIES["s6_a2_rows_and_count"] = _counted
ORACLE["s6_a2_rows_and_count"] = """SELECT '{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","n":"' || n || '"}' AS row,
  count(*) OVER () AS row_count FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)"""


def _failures(spark, sf_dir):
    failed = asset(spark, sf_dir, "cli_runs").filter("return_code <> 0").select("run_id", F.concat(F.lit("no bundle at "), "bundle_path").alias("error"))
    return config.validation_failures(failed).select("run_id", F.to_json(F.struct(
        "validation_passed", "validation_summary", "errors", "warnings", "best_practices", "security_checks", "recommendations")).alias("response"))


QUERIES["g3_validation_failures"] = _failures
ORACLE["g3_validation_failures"] = over("""SELECT run_id, '{"validation_passed":false,"validation_summary":{"total_errors":1,"total_warnings":0},"errors":["' || e
    || '"],"warnings":[],"best_practices":{"score":0,"suggestions":[]},"security_checks":{"passed":false,"issues":["' || e
    || '"]},"recommendations":{"immediate_actions":["' || e || '"],"improvements":[],"next_steps":["Fix the error and try again"]}}' AS response
  FROM (SELECT run_id, 'no bundle at ' || bundle_path AS e FROM cli_runs WHERE return_code <> 0)""", "cli_runs")
