"""Config rendering, linting, run logs, advice and bundle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeharbor.catalog import files_extract as fx
from codeharbor.catalog.inventory import STEM, TASK_TYPES
from codeharbor.catalog.views import FILES, over, text
from codeharbor.functions import rules
from codeharbor.operators import config as cfg
from codeharbor.operators import inventory as inv
from codeharbor.plans.running import stored
from codeharbor.sources.assets import asset
from codeharbor.sources.corpus import code_corpus

QUERIES = {}
ORACLE = {}


def on(views, name, sql, fn, *ctes):
    views = [views] if isinstance(views, str) else views
    QUERIES[name] = lambda spark, sf_dir: fn(*[asset(spark, sf_dir, v) for v in views])
    if sql is not None:
        ORACLE[name] = over(sql, *views, *ctes)


def joined(column, alias=None):
    return F.array_join(column, "|").alias(alias or column)


def texts(pairs):
    """array_to_string over the texts whose condition holds."""
    cases = ", ".join(f"CASE WHEN {condition} THEN {text(value)} END" for condition, value in pairs)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|')"


# ---- lints -----------------------------------------------------------------------------------

NO_STOP, NO_MAIL = "NOT contains(content, 'autotermination_minutes')", "NOT contains(content, 'email_notifications')"
NO_SPOT = "(target = 'dev' AND NOT contains(lower(content), 'spot'))"
SCORE = f"""100 - CASE WHEN {NO_STOP} THEN 10 ELSE 0 END - CASE WHEN {NO_SPOT} THEN 5 ELSE 0 END
  - CASE WHEN {NO_MAIL} THEN 10 ELSE 0 END"""
PRACTICES = texts([(NO_STOP, rules.PRACTICE_AUTOTERMINATION), (NO_SPOT, rules.PRACTICE_SPOT),
                   (NO_MAIL, rules.PRACTICE_EMAIL)])


def bare(key):
    at = f"strpos(lower(content), '{key}')"
    return f"({at} > 0 AND NOT contains(substring(content, {at}, 50), '${{'))"


SECRETS = texts([(bare("password:"), rules.SECRET_PASSWORD), (bare("api_key:"), rules.SECRET_API_KEY)])
LINTED = f"""linted AS MATERIALIZED (SELECT path, {SCORE} AS score, {PRACTICES} AS suggestions, {SECRETS} AS issues
  FROM configs)"""
on("configs", "c6_lint_practices", "SELECT path, CAST(score AS BIGINT) AS score, suggestions FROM linted",
   lambda c: cfg.lint_practices(c, F.col("target")).select("path", "score", joined("suggestions")), LINTED)
on("configs", "c7_lint_secrets", "SELECT path, issues = '' AS passed, issues FROM linted",
   lambda c: cfg.lint_secrets(c).select("path", "passed", joined("issues")), LINTED)

# template -> structural errors and advice, known from the template texts
KNOWN_ERRORS = {
    1: [rules.LINT_NO_NAME, rules.LINT_NO_JOB_NAME, rules.LINT_NO_TASKS],
    3: [rules.LINT_SECRETS],
    4: [rules.LINT_BAD_YAML],
    5: [rules.LINT_SECRETS],
}
NO_CARE = [rules.LINT_NO_EMAIL, rules.LINT_NO_TIMEOUT, rules.LINT_NO_RETRIES]
KNOWN_ADVICE = {
    1: [*NO_CARE, rules.LINT_PROD_MODE], 2: [rules.LINT_VAGUE_NAME, *NO_CARE], 3: NO_CARE,
    5: [rules.LINT_NO_TIMEOUT, rules.LINT_NO_RETRIES],
}


def by_template(known):
    whens = " ".join(f"WHEN {t} THEN {text('|'.join(values))}" for t, values in known.items())
    return f"CASE template {whens} ELSE '' END"


PROD_ADVICE = "|".join([rules.LINT_VAGUE_NAME, rules.LINT_EXISTING_CLUSTER, *NO_CARE])
on("configs", "c8_lint_config", f"""SELECT path, {by_template(KNOWN_ERRORS)} = '' AS passed,
    {by_template(KNOWN_ERRORS)} AS errors,
    CASE WHEN template = 2 AND target = 'prod' THEN {text(PROD_ADVICE)} ELSE {by_template(KNOWN_ADVICE)} END AS advice
  FROM configs""",
   lambda c: cfg.lint_config(c, F.col("target")).select("path", "passed", joined("errors"), joined("advice")))

# ---- run logs ------------------------------------------------------------------------------------


def marked(mark):
    return (f"list_transform(list_filter(list_transform(string_split(stderr, chr(10)), lambda l: trim(l)), "
            f"lambda l: starts_with(l, '{mark}')), lambda l: trim(substring(l, {len(mark) + 1})))")


def info(key):
    last = f"list_extract(regexp_extract_all(stdout, '(?m)^{key}:(.*)$', 1), -1)"
    return f"CASE WHEN contains(stdout, 'Name:') THEN trim({last}) END AS {key.lower()}"


PARSED = f"""parsed AS MATERIALIZED (SELECT run_id, bundle_path, target, return_code, stdout, stderr,
  return_code = 0 OR contains(stdout, {text(rules.SUCCESS_PHRASE)}) AS validation_passed,
  {marked('Error:')} AS errors, {marked('Warning:')} AS warnings FROM cli_runs)"""
on("cli_runs", "g2_parse_cli_runs", """SELECT run_id, validation_passed, array_to_string(errors, '|') AS errors,
    array_to_string(warnings, '|') AS warnings, right(stdout, 1000) AS stdout_tail, right(stderr, 1000) AS stderr_tail
  FROM parsed""",
   lambda r: cfg.parse_cli_runs(r, 1000).select("run_id", "validation_passed", joined("errors"), joined("warnings"),
                                          "stdout_tail", "stderr_tail"), PARSED)
on("cli_runs", "a9_run_counts", """SELECT run_id, len(errors) AS total_errors, len(warnings) AS total_warnings,
  return_code FROM parsed""",
   lambda r: cfg.parse_cli_runs(r).select("run_id", "total_errors", "total_warnings", "return_code"), PARSED)
on("cli_runs", "f7_cli_info", f"""SELECT run_id, {', '.join(info(k) for k in ('Name', 'Target', 'Host', 'User', 'Path'))}
  FROM cli_runs""", lambda r: r.select("run_id", cfg.cli_info(F.col("stdout")).alias("i")).select("run_id", "i.*"))
TRIM = "trim({0}, ' ' || chr(10))"
on("cli_runs", "g3_validation_rows", f"""SELECT run_id, return_code = 0 AS validation_passed, bundle_path,
    target AS target_environment, 'databricks bundle validate -t ' || target AS command,
    {TRIM.format('stdout')} AS stdout, CASE WHEN stderr <> '' THEN {TRIM.format('stderr')} END AS stderr, return_code
  FROM cli_runs""", cfg.validation_rows)
on("cli_runs", "g3_validation_rows_sdk", f"""SELECT run_id, return_code = 0 AS valid, bundle_path, target,
    CASE WHEN stdout <> '' THEN {TRIM.format('stdout')} ELSE {TRIM.format('stderr')} END AS output FROM cli_runs""",
   lambda r: cfg.validation_rows(r, "sdk"))

# ---- advice ------------------------------------------------------------------------------------

VALIDATED = (PARSED, LINTED, """validated AS MATERIALIZED (SELECT p.*, l.score, l.suggestions, l.issues
  FROM parsed p LEFT JOIN linted l ON l.path = p.bundle_path || '/databricks.yml')""")


def parts(*pieces):
    return f"concat_ws('|', {', '.join(f'nullif({p}, {text('')})' for p in pieces)})"


def when(condition, values):
    return f"CASE WHEN {condition} THEN {text('|'.join(values))} ELSE '' END"


def bullets(expression):
    return f"array_to_string(list_transform(({expression})[1:3], lambda x: '- ' || x), '|')"


SERVICE, TOOL = rules.SERVICE_ADVICE, rules.TOOL_ADVICE
on(["cli_runs", "configs"], "c9_advice_service", f"""SELECT run_id,
    {parts(when('len(errors) > 0', SERVICE['errors']), bullets('errors'), "coalesce(issues, '')")} AS immediate_actions,
    {parts(when('len(warnings) > 0', SERVICE['warnings']), when('score < 80', SERVICE['score']),
           bullets("CASE WHEN coalesce(suggestions, '') = '' THEN [] ELSE string_split(suggestions, '|') END"))} AS improvements,
    {parts(when('validation_passed', SERVICE['passed']), when('NOT validation_passed', SERVICE['failed']))} AS next_steps
  FROM validated""",
   lambda r, c: cfg.advice(cfg.validate(r, c), first=3).select(
       "run_id", joined("immediate_actions"), joined("improvements"), joined("next_steps")), *VALIDATED)
on(["cli_runs", "configs"], "c10_advice_tool", f"""SELECT run_id,
    {parts(when('len(errors) > 0', TOOL['errors']), when("coalesce(issues, 'x') <> ''", TOOL['security']))} AS immediate_actions,
    {parts(when('coalesce(score, 0) < 80', TOOL['score']), when('coalesce(score, 0) < 60', TOOL['low_score']),
           when('len(warnings) > 0', TOOL['warnings']))} AS improvements,
    {parts(when('validation_passed', TOOL['passed']), when('NOT validation_passed', TOOL['failed']))} AS next_steps
  FROM validated""",
   lambda r, c: cfg.advice(cfg.validate(r, c), "tool").select(
       "run_id", joined("immediate_actions"), joined("improvements"), joined("next_steps")), *VALIDATED)

# ---- clusters ------------------------------------------------------------------------------------

on("clusters", "g1_render_cluster", """SELECT cluster_id, 'job_clusters:' || chr(10) || '  - job_cluster_key: main_cluster'
    || chr(10) || '    new_cluster:' || chr(10) || '      spark_version: "' || spark_version || '"' || chr(10)
    || '      node_type_id: "' || node_type_id || '"' || chr(10) || '      num_workers: ' || coalesce(num_workers, 0)
    || CASE WHEN autotermination_minutes > 0 THEN chr(10) || '      autotermination_minutes: ' || autotermination_minutes ELSE '' END
    || CASE WHEN conf_json <> '{}' THEN chr(10) || '      spark_conf:'
       || chr(10) || '        spark.app.kind: "' || regexp_extract(conf_json, 'kind": "([^"]*)"', 1) || '"'
       || chr(10) || '        spark.sql.shuffle.partitions: "' || regexp_extract(conf_json, 'partitions": "([^"]*)"', 1) || '"'
       ELSE '' END AS job_cluster_yaml FROM clusters""", cfg.render_cluster)
on("tasks", "c5_cluster_choice", f"""SELECT job_id, task_key, CASE WHEN type = 'notebook' THEN 'serverless'
    WHEN job_id % 3 = 0 THEN 'job_cluster' WHEN job_id % 3 = 1 THEN 'environment' ELSE 'ask' END AS choice
  FROM (SELECT job_id, task_key, {TASK_TYPES} FROM tasks)""",
   lambda t: inv.task_type(t).select("job_id", "task_key", cfg.cluster_choice(
       F.col("type"), F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("c-"), F.col("job_id"))),
       F.col("job_id") % 3 == 1).alias("choice")))

# ---- bundles ------------------------------------------------------------------------------------

SDK_LIB_LIST = f"""(SELECT path, string_agg(library, ',' ORDER BY ordinal) AS libraries
  FROM ({fx.SDK_LIBS}) GROUP BY path)"""
STREAMING = fx.has("lower(content)", rules.STREAMING_WORDS)
MEMBERS = f"""analysed AS (
  SELECT {STEM} AS stem, {fx.SDK_WORKFLOW} AS workflow_type, coalesce(l.libraries, '') AS libraries,
    {STREAMING} AS uses_streaming FROM files LEFT JOIN {SDK_LIB_LIST} l USING (path)),
members AS MATERIALIZED (
  SELECT b.bundle_name, b.stem, a.workflow_type, a.libraries, a.uses_streaming,
    list_contains(string_split(a.libraries, ','), 'mlflow') AS uses_mlflow,
    CASE WHEN a.workflow_type IS NULL THEN 'Could not analyze file' END AS error
  FROM (SELECT DISTINCT 'job-' || job_id || '-bundle' AS bundle_name, target AS stem
        FROM (SELECT job_id, {TASK_TYPES} FROM tasks) WHERE type = 'notebook') b LEFT JOIN analysed a USING (stem))"""
DOMINANT = """SELECT bundle_name, coalesce(arg_min(workflow_type, rank), 'etl') AS dominant_workflow FROM (
    SELECT bundle_name, workflow_type, CASE WHEN workflow_type IS NOT NULL THEN
      row_number() OVER (PARTITION BY bundle_name ORDER BY (workflow_type IS NULL), count(*) DESC, workflow_type) END AS rank
    FROM members GROUP BY bundle_name, workflow_type) GROUP BY bundle_name"""


def on_members(name, sql, fn):
    def run(spark, sf_dir):
        tasks = asset(spark, sf_dir, "tasks")
        return fn(cfg.bundle_files(cfg.bundles_from_jobs(tasks), code_corpus(spark, sf_dir)))

    QUERIES[name] = run
    ORACLE[name] = over(sql, FILES, "tasks", MEMBERS)


on_members("j2_bundle_files", "SELECT bundle_name, stem, workflow_type, libraries, uses_mlflow, error FROM members",
           lambda m: m.select("bundle_name", "stem", "workflow_type", joined("libraries").alias("libraries"),
                              "uses_mlflow", "error").withColumn("libraries", F.translate("libraries", "|", ",")))
on_members("a1_dominant_workflow", DOMINANT, cfg.dominant_workflow)
PATTERN = """SELECT bundle_name, count(*) AS n_files, CASE WHEN bool_or(coalesce(uses_mlflow, false)) THEN 'ml'
    WHEN count(*) > 1 THEN 'multi_stage' WHEN bool_or(coalesce(uses_streaming, false)) THEN 'streaming'
    ELSE 'simple' END AS pattern FROM members GROUP BY bundle_name"""
on_members("c4_bundle_pattern", PATTERN, cfg.bundle_pattern)
on_members("g5_bundle_context", f"""SELECT bundle_name, count(*) AS n_files, count(error) AS n_failed,
    any_value(dominant_workflow) AS dominant_workflow, './' || bundle_name AS output_path,
    'https://your-workspace.example.com' AS workspace_host, count(*) || ' files analyzed' AS analysis_note
  FROM members JOIN ({DOMINANT}) USING (bundle_name) GROUP BY bundle_name""", cfg.bundle_context)
on_members("g5_bundle_analyses", """SELECT bundle_name, stem, CASE WHEN error IS NOT NULL THEN '{"error":"' || error || '"}'
    ELSE '{"workflow_type":"' || workflow_type || '","libraries":[' || CASE WHEN libraries = '' THEN '' ELSE
      '"' || replace(libraries, ',', '","') || '"' END || '],"uses_mlflow":' || uses_mlflow || '}' END AS analysis
  FROM members""", cfg.bundle_analyses)


def _render(spark, sf_dir):
    tasks = asset(spark, sf_dir, "tasks")
    members = cfg.bundle_files(stored(cfg.bundles_from_jobs(tasks), "bundles"), code_corpus(spark, sf_dir))
    patterns = stored(cfg.bundle_pattern(members), "patterns")  # the texts are read for them once
    return cfg.render_bundle(asset(spark, sf_dir, "jobs"), tasks, patterns)


def pattern_case(position):
    whens = " ".join(f"WHEN {text(p)} THEN {text(str(row[position]))}" for p, row in rules.BUNDLE_PATTERNS.items())
    return f"CASE pattern {whens} END"


NL = " || chr(10) || "
QUERIES["g4_render_bundle"] = _render
ORACLE["g4_render_bundle"] = over(f"""SELECT bundle_name, 0::BIGINT AS section, '' AS sort_key, 'bundle:' {NL} '  name: ' || bundle_name
    {NL} 'resources:' {NL} '  jobs:' {NL} '    ' || {pattern_case(0)} || ':' {NL} '      name: ${{bundle.name}}-${{bundle.target}}'
    {NL} '      job_clusters:' {NL} '        - job_cluster_key: ' || {pattern_case(1)} {NL} '          new_cluster:'
    {NL} '            spark_version: "' || {pattern_case(2)} || '"' {NL} '            node_type_id: "' || {pattern_case(3)} || '"'
    {NL} '            num_workers: ' || {pattern_case(4)} {NL} '      tasks:' || chr(10) AS text FROM named
  UNION ALL SELECT bundle_name, 2, '', {text(rules.TARGETS_BLOCK)} FROM named
  UNION ALL SELECT bundle_name, 1, t.task_key || ' ' || t.target, '        - task_key: ' || t.task_key
    || CASE WHEN upstream_key IS NOT NULL THEN chr(10) || '          depends_on: [{{task_key: ' || upstream_key || '}}]' ELSE '' END
    {NL} '          notebook_task:' {NL} '            notebook_path: ' || t.target {NL} '          job_cluster_key: '
    || {pattern_case(1)} || chr(10)
  FROM (SELECT 'job-' || job_id || '-bundle' AS bundle_name, task_key, upstream_key, {TASK_TYPES} FROM tasks) t
  JOIN named USING (bundle_name) WHERE t.type = 'notebook'""", FILES, "tasks", "jobs", MEMBERS,
    f"named AS (SELECT p.* FROM ({PATTERN}) p JOIN jobs j ON p.bundle_name = 'job-' || j.job_id || '-bundle')")
