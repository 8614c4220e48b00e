"""Asset, config, run-log and message tables derived from the driver tables.

Each view is a list of parts (base table, expressions, filter). The expressions are plain SQL
that reads the same in both engines, so the oracle derives identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeharbor.sources.corpus import PROJECTS, USERS, code_corpus, load
from codeharbor.sources.templates import CONFIG_TEMPLATES, RUN_STDERR, RUN_STDOUT


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(index: str, bodies: list[str], marks: dict[str, str]) -> str:
    """CASE over templates with their marks replaced; texts hold no backslash, so both engines
    read the literals alike."""
    whens = []
    for number, body in enumerate(bodies):
        filled = "||".join(
            marks.get(piece, _literal(piece)) for piece in _split(body, marks)
        )
        whens.append(f"WHEN {number} THEN {filled or _quote('')}")
    return f"CASE {index} {' '.join(whens)} END"


def _literal(piece: str) -> str:
    """A literal without line feeds, and without the mark Spark takes for a variable."""
    return _quote(piece).replace("\n", "' || chr(10) || '").replace("${", "$' || '{")


def _split(body: str, marks: dict[str, str]) -> list[str]:
    pieces = [body]
    for mark in marks:
        pieces = [p for piece in pieces for p in _around(piece, mark, marks)]
    return [p for p in pieces if p]


def _around(piece: str, mark: str, marks: dict[str, str]) -> list[str]:
    if piece in marks:
        return [piece]
    parts = piece.split(mark)
    out = [parts[0]]
    for part in parts[1:]:
        out += [mark, part]
    return out


def _str(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _stem(key: str) -> str:
    return (f"'/Workspace/Users/u' || {_str(f'{key} % {USERS}')} || '/proj' || {_str(f'{key} % {PROJECTS}')}"
            f" || '/nb_' || {_str(key)}")


TOOL_NAME = """CASE event_type WHEN 'click' THEN 'mcp__databricks-mcp__analyze_notebook'
  WHEN 'view' THEN 'mcp__databricks__execute_dbsql' WHEN 'purchase' THEN 'mcp__databricks-mcp__run_job'
  WHEN 'signup' THEN 'Task' ELSE 'mcp__databricks-mcp__validate_bundle' END"""
_RUN_MARKS = {"{key}": _str("o_orderkey"), "{cust}": _str("o_custkey"), "{pad}": "repeat('tail ' || o_orderpriority || ' ', 60)"}
_FENCED = """text || CASE WHEN turn % 4 = 3 THEN chr(10) || '```yaml' || chr(10) || 'bundle:' || chr(10) || '  name: b'
    || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || chr(10) || '```' || chr(10)
  WHEN turn % 4 = 1 THEN chr(10) || '```python' || chr(10) || 'resources: no' || chr(10) || '```' || chr(10)
    || '```' || chr(10) || ' resources: {r: ' || CAST(turn AS STRING) || '}  ' || chr(10) || '``` Go and Java, JavaScript'
  ELSE ' Rust' END"""

# view -> parts of (base, expressions, filter)
VIEWS: dict[str, list[tuple[str, list[str], str | None]]] = {
    "jobs": [("orders", [
        "o_orderkey AS job_id",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE lower(substring(o_orderpriority, 3, 20)) || CASE o_orderstatus "
        "WHEN 'F' THEN '-etl-' WHEN 'O' THEN '-Big ETL-' ELSE '-report-' END || CAST(o_orderkey AS STRING) END AS name",
        "CAST(o_orderdate AS STRING) AS created_time",
        "'user' || CAST(o_custkey AS STRING) AS creator_user_name",
        "CAST(1 + o_orderkey % 4 AS BIGINT) AS max_concurrent_runs",
        "CAST(600 * (o_orderkey % 3) AS BIGINT) AS timeout_seconds",
    ], None)],
    "tasks": [("lineitem", [
        "l_orderkey AS job_id",
        "'task_' || CAST(l_linenumber AS STRING) AS task_key",
        "CASE WHEN l_linenumber > 1 THEN 'task_' || CAST(l_linenumber - 1 AS STRING) END AS upstream_key",
        "CASE WHEN l_returnflag = 'A' THEN '{\"notebook_task\": {\"notebook_path\": \"' || " + _stem("l_partkey") +
        " || '\"}}' WHEN l_returnflag = 'N' THEN '{\"python_wheel_task\": {\"package_name\": \"pkg_' "
        "|| CAST(l_suppkey AS STRING) || '\"}}' WHEN l_linestatus = 'F' THEN '{\"spark_python_task\": {\"python_file\": "
        "\"/jobs/f_' || CAST(l_partkey AS STRING) || '.py\"}}' ELSE '{\"sql_task\": {}}' END AS settings",
    ], None)],
    "storage": [("pages", [
        "'/FileStore/' || regexp_replace(url, '^https?://', '') AS path",
        "url LIKE '%/' AS is_dir",
        "CAST(length(html) AS BIGINT) AS file_size",
    ], None)],
    "warehouses": [("supplier", [
        "'wh-' || CAST(s_suppkey AS STRING) AS warehouse_id",
        "s_name AS name",
        "CASE WHEN s_acctbal > 5000 THEN 'Large' WHEN s_acctbal > 1000 THEN 'Small' ELSE '2X-Small' END AS size",
        "CASE s_nationkey % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'STOPPED' END AS state",
        "CAST(s_nationkey * 5 AS BIGINT) AS auto_stop_mins",
    ], None)],
    "clusters": [("part", [
        "'c-' || CAST(p_partkey AS STRING) AS cluster_id",
        "p_name AS cluster_name",
        "CASE p_size % 3 WHEN 0 THEN '13.3.x-scala2.12' WHEN 1 THEN '14.3.x-ml-scala2.12' ELSE '16.4.x-scala2.12' END AS spark_version",
        "replace(lower(p_brand), '#', '.') AS node_type_id",
        "CASE WHEN p_size % 2 = 0 THEN 'driver.' || lower(p_type) END AS driver_node_type_id",
        "p_size > 25 AS enable_elastic_disk",
        "CASE WHEN p_size % 5 <> 0 THEN 'UI' END AS cluster_source",
        "CASE WHEN p_size % 7 <> 0 THEN p_type END AS tag",
        "CAST(nullif(p_size % 9, 0) AS BIGINT) AS num_workers",
        "CAST((p_size % 4) * 10 AS BIGINT) AS autotermination_minutes",
        "CASE WHEN p_size % 3 = 0 THEN '{}' ELSE '{\"spark.sql.shuffle.partitions\": \"' || CAST(p_size AS STRING) || "
        "'\", \"spark.app.kind\": \"' || p_type || '\"}' END AS conf_json",
        "CASE WHEN p_size % 2 = 0 THEN 'RUNNING' END AS state",
    ], None)],
    "configs": [("customer", [
        "'/bundles/c' || CAST(c_custkey AS STRING) || '/databricks.yml' AS path",
        _case(f"c_custkey % {len(CONFIG_TEMPLATES)}", CONFIG_TEMPLATES,
              {"{key}": _str("c_custkey"), "{seg}": "lower(c_mktsegment)"}) + " AS content",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'dev' ELSE 'prod' END AS target",
        f"CAST(c_custkey % {len(CONFIG_TEMPLATES)} AS BIGINT) AS template",
    ], None)],
    "cli_runs": [("orders", [
        "o_orderkey AS run_id",
        "'/bundles/c' || CAST(o_custkey AS STRING) AS bundle_path",
        "CASE WHEN o_orderstatus = 'P' THEN 'prod' ELSE 'dev' END AS target",
        _case("o_orderkey % 3", RUN_STDOUT, _RUN_MARKS) + " AS stdout",
        _case("(o_custkey + o_orderkey) % 3", RUN_STDERR, _RUN_MARKS) + " AS stderr",
        "CAST(CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS return_code",
    ], None)],
    "messages": [
        ("conversations", [
            "'conv-' || CAST(conv_id AS STRING) AS session_id",
            "CAST(floor(turn / 2) AS BIGINT) AS turn_id",
            "CAST(turn AS BIGINT) AS seq",
            "role AS msg_type", "'text' AS block_type",
            "CAST(NULL AS STRING) AS tool_name", "CAST(NULL AS STRING) AS tool_input",
            _FENCED + " AS text", "CAST(NULL AS DOUBLE) AS cost",
        ], None),
        ("events", [
            "'user-' || CAST(user_id AS STRING) AS session_id",
            "CAST(floor(event_id / 500) AS BIGINT) AS turn_id",
            "event_id * 2 AS seq",
            "'assistant' AS msg_type", "'tool_use' AS block_type",
            TOOL_NAME + " AS tool_name",
            "CASE WHEN event_type = 'signup' AND value > 10 THEN '{\"subagent_type\": \"analyst\", \"description\": \"look at ' "
            "|| CAST(user_id AS STRING) || '\"}' WHEN event_type = 'signup' THEN '{}' ELSE props END AS tool_input",
            "CAST(NULL AS STRING) AS text", "CAST(NULL AS DOUBLE) AS cost",
        ], None),
        ("events", [
            "'user-' || CAST(user_id AS STRING) AS session_id",
            "CAST(floor(event_id / 500) AS BIGINT) AS turn_id",
            "event_id * 2 + 1 AS seq",
            "CASE WHEN event_type = 'purchase' THEN 'result' ELSE 'user' END AS msg_type",
            "CASE WHEN event_type = 'purchase' THEN 'result' ELSE 'tool_result' END AS block_type",
            TOOL_NAME + " AS tool_name", "CAST(NULL AS STRING) AS tool_input",
            "repeat('outcome ' || event_type || ' ' || props || ' ', 30) AS text",
            "CASE WHEN event_type = 'purchase' THEN value / 1000 END AS cost",
        ], None),
    ],
    "tool_calls": [("events", [
        "event_id AS call_id", "user_id AS session_id", "ts",
        "CASE event_type WHEN 'click' THEN 'export_notebook' WHEN 'view' THEN 'execute_dbsql' WHEN 'purchase' THEN "
        "'run_job' WHEN 'signup' THEN 'list_jobs' ELSE 'validate_bundle' END AS tool_name",
    ], None)],
    "qa": [("documents", [
        "doc_id AS qa_id",
        "'How many characters has document ' || CAST(doc_id AS STRING) || '?' AS question",
        "CASE WHEN doc_id % 8 = 7 THEN 'UPDATE_WITH_ACTUAL_COUNT' WHEN doc_id % 8 = 6 THEN ' SRC ' "
        "ELSE CAST(n_chars AS STRING) END AS expected",
        "CASE doc_id % 8 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN '  ' || CAST(n_chars AS STRING) || '.0 ' "
        "WHEN 2 THEN 'It has ' || CAST(n_chars AS STRING) || ' characters' WHEN 3 THEN '' WHEN 4 THEN NULL "
        "WHEN 5 THEN CAST(n_chars + 1 AS STRING) WHEN 6 THEN upper(source) ELSE 'unknown' END AS actual",
        "CASE WHEN lang = 'en' THEN 'list_jobs' ELSE '' END AS tools_needed",
        "CASE WHEN n_chars > 1000 THEN 'moderate' ELSE 'simple' END AS complexity",
        "CASE WHEN doc_id % 8 = 4 THEN 'timeout ' || source END AS error",
    ], None)],
    "test_results": [("events", [
        "event_id AS test_no", "event_type AS suite",
        "event_type <> 'error' AND value >= 1 AS success",
        "CASE WHEN event_type = 'error' THEN 'exception ' || props END AS exception",
        "CASE WHEN value < 0.5 THEN 'low value ' || props END AS error",
    ], None)],
    "transactions": [("lineitem", [
        "CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS transaction_id",
        "l_partkey AS customer_id",
        "CASE WHEN l_quantity < 2 THEN NULL WHEN l_returnflag = 'R' AND l_quantity > 48 THEN -l_extendedprice "
        "ELSE l_extendedprice END AS amount",
        "CAST(l_shipdate AS DATE) AS transaction_date",
    ], None)],
    "sources": [("orders", [
        "o_orderkey AS source_id",
        "CASE o_orderkey % 9 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN '/Workspace/Users/U' || CAST(o_custkey AS STRING) "
        "|| '/My_Load  Job' || CAST(o_orderkey AS STRING) || '.py' WHEN 2 THEN '/Repos/team/Repo ' || o_orderpriority "
        "WHEN 3 THEN './local/dir_' || CAST(o_custkey AS STRING) || '/' WHEN 4 THEN '../up/file__' || o_orderstatus || '.tar.gz' "
        "WHEN 5 THEN '-' || CAST(o_orderkey AS STRING) WHEN 6 THEN '/abs/___' WHEN 7 THEN 'plain-' || lower(o_orderpriority) "
        "ELSE '' END AS source",
    ], None)],
}


def asset(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    parts = []
    for base, expressions, where in VIEWS[view]:
        rows = load(spark, sf_dir, base)
        parts.append((rows.filter(where) if where else rows).selectExpr(*expressions))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if view == "clusters":
        scripts = F.array(F.struct(F.concat(F.lit("/init/"), F.col("tag"), F.lit(".sh")).alias("destination")))
        whole = whole.withColumns({
            "spark_conf": F.from_json("conf_json", "map<string,string>"),
            "spark_env_vars": F.lit(None).cast("map<string,string>"),
            "custom_tags": F.when(F.col("tag").isNotNull(), F.create_map(F.lit("kind"), F.col("tag"))),
            "init_scripts": F.when(F.col("tag").isNotNull(), scripts),
        })
    if view == "tasks":
        whole = whole.withColumn("depends_on", F.array_compact(F.array("upstream_key")))
    return whole


NOTEBOOK_EXPRESSIONS = [
    "path",
    "CASE WHEN path LIKE '%.py' THEN 'PYTHON' WHEN path LIKE '%.sql' THEN 'SQL' WHEN path LIKE '%.scala' THEN 'SCALA' END AS language",
    "CAST(length(content) AS BIGINT) AS size",
    "doc_id AS modified_at",
]


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_corpus(spark, sf_dir).selectExpr(*NOTEBOOK_EXPRESSIONS)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers(id, customer_name, customer_segment, region)."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("r_name").alias("region"),
    )


WORKSPACE_CONFIGS = [
    ("supplier", "'/Workspace/Users/u' || CAST(s_suppkey AS STRING) || '/databricks.yml' AS config_path"),
    ("nation", "'/Workspace/Users/u' || CAST(n_nationkey AS STRING) || '/proj' || CAST(n_regionkey AS STRING) "
               "|| '/databricks.yml' AS config_path"),
]


def workspace_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config_path of config files that lie in user and project folders."""
    first, second = [load(spark, sf_dir, base).selectExpr(expression) for base, expression in WORKSPACE_CONFIGS]
    return first.unionByName(second)
