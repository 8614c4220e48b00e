"""Asset listings, lookups, task graphs, path functions and the ten golden questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeharbor.catalog import files_extract as fx
from codeharbor.catalog.views import FILES, NOTEBOOKS, WORKSPACE_CONFIG_CTE, over
from codeharbor.functions import paths, rules
from codeharbor.functions import text as tx
from codeharbor.operators import inventory as inv
from codeharbor.operators import lineage
from codeharbor.operators.classify import quick_workflow
from codeharbor.sources.assets import asset, notebooks, workspace_configs
from codeharbor.sources.corpus import code_corpus

QUERIES = {}
ORACLE = {}


def on(views, name, sql, fn, *ctes):
    """Register a query over asset views; `fn` takes their frames in order."""
    views = [views] if isinstance(views, str) else views
    QUERIES[name] = lambda spark, sf_dir: fn(*[asset(spark, sf_dir, v) for v in views])
    if sql is not None:
        ORACLE[name] = over(sql, *views, *ctes)


def on_notebooks(name, sql, fn):
    QUERIES[name] = lambda spark, sf_dir: fn(notebooks(spark, sf_dir))
    ORACLE[name] = over(sql, FILES, NOTEBOOKS)


def on_files(name, sql, fn, *ctes):
    QUERIES[name] = lambda spark, sf_dir: fn(code_corpus(spark, sf_dir))
    ORACLE[name] = over(sql, FILES, *ctes)


JOB = "job_id, name, created_time, creator_user_name"
on("jobs", "p1_list_jobs", f"SELECT {JOB} FROM jobs WHERE lower(name) LIKE '%etl%' ORDER BY job_id LIMIT 100",
   lambda j: inv.list_jobs(j, 100, "ETL"))
on("jobs", "p1_list_all_matching_jobs", f"SELECT {JOB} FROM jobs WHERE lower(name) LIKE '%report%'",
   lambda j: inv.list_jobs(j, None, "Report"))
on("jobs", "w4_top_n", "SELECT creator_user_name, job_id FROM jobs ORDER BY job_id LIMIT 25",
   lambda j: inv.top_n(j.select("creator_user_name", "job_id"), "job_id", 25))
on("warehouses", "p2_project_assets", """SELECT warehouse_id, name, size, coalesce(state, 'UNKNOWN') AS state,
  auto_stop_mins FROM warehouses""", inv.list_warehouses)
on("clusters", "p2_project_clusters", """SELECT cluster_id, cluster_name, spark_version, node_type_id, driver_node_type_id,
    num_workers, autotermination_minutes, enable_elastic_disk, cluster_source, state, replace(conf_json, '": "', '":"') AS conf,
    '{}' AS env, CASE WHEN tag IS NULL THEN '{}' ELSE '{"kind":"' || tag || '"}' END AS tags,
    CASE WHEN tag IS NULL THEN '' ELSE '/init/' || tag || '.sh' END AS scripts FROM clusters""",
   lambda c: inv.project_assets(c, "cluster").select(
       "cluster_id", "cluster_name", "spark_version", "node_type_id", "driver_node_type_id", "num_workers",
       "autotermination_minutes", "enable_elastic_disk", "cluster_source", "state",
       F.replace(F.to_json("spark_conf"), F.lit(","), F.lit(", ")).alias("conf"), F.to_json("spark_env_vars").alias("env"),
       F.to_json("custom_tags").alias("tags"), F.array_join("init_scripts.destination", ",").alias("scripts")))
on("clusters", "p2_project_clusters_sdk", """SELECT cluster_id, cluster_name AS name, spark_version, node_type_id,
  num_workers, state FROM clusters""", lambda c: inv.project_assets(c, "cluster", "sdk"))
on("warehouses", "p2_project_warehouses_sdk", """SELECT warehouse_id AS id, name, size, coalesce(state, 'UNKNOWN') AS state
  FROM warehouses""", lambda w: inv.project_assets(w, "warehouse", "sdk"))
on("jobs", "p1_list_jobs_sdk", """SELECT job_id, name, creator_user_name AS creator FROM jobs
  WHERE lower(name) LIKE '%etl%'""", lambda j: inv.list_jobs(j, None, "etl", "sdk"))
on("warehouses", "f10_with_default", "SELECT warehouse_id, coalesce(state, 'UNKNOWN') AS state FROM warehouses",
   lambda w: w.select("warehouse_id", tx.with_default(F.col("state"), "UNKNOWN").alias("state")))
on("jobs", "p3_get_job", f"""SELECT {JOB}, max_concurrent_runs, timeout_seconds, CAST(NULL AS VARCHAR) AS error FROM jobs
  WHERE job_id = 1234""", lambda j: inv.get_job(j, 1234))
on("jobs", "p3_get_job_missing", """SELECT CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS VARCHAR) AS name,
  CAST(NULL AS VARCHAR) AS created_time, CAST(NULL AS VARCHAR) AS creator_user_name, CAST(NULL AS BIGINT) AS max_concurrent_runs,
  CAST(NULL AS BIGINT) AS timeout_seconds, 'job -5 not found' AS error
  WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE job_id = -5)""", lambda j: inv.get_job(j, -5))
on("clusters", "p3_get_cluster", """SELECT cluster_id, cluster_name, spark_version, node_type_id, num_workers, state,
  CAST(NULL AS VARCHAR) AS error FROM clusters WHERE cluster_id = 'c-17'""", lambda c: inv.get_cluster(c, "c-17", "sdk").withColumnRenamed("name", "cluster_name"))
TASK_TYPES = """CASE WHEN settings LIKE '%notebook_task%' THEN 'notebook' WHEN settings LIKE '%python_wheel_task%'
  THEN 'python_wheel' WHEN settings LIKE '%spark_python_task%' THEN 'spark_python' END AS type,
  nullif(regexp_extract(settings, '"(?:notebook_path|package_name|python_file)": "([^"]*)"', 1), '') AS target"""
on("tasks", "p3_job_tasks", f"""SELECT job_id, task_key, {TASK_TYPES}, coalesce(upstream_key, '') AS depends_on
  FROM tasks""", lambda t: inv.job_tasks(t).withColumn("depends_on", F.array_join("depends_on", ",")))
on("tasks", "g7_task_type", f"SELECT job_id, task_key, {TASK_TYPES} FROM tasks", inv.task_type)
on("tasks", "g7_task_type_sdk", f"""SELECT job_id, task_key, CASE type WHEN 'notebook' THEN 'notebook'
  WHEN 'python_wheel' THEN 'python' ELSE 'other' END AS type, CASE WHEN type = 'notebook' THEN target END AS target
  FROM (SELECT job_id, task_key, {TASK_TYPES} FROM tasks)""", lambda t: inv.task_type(t, "sdk"))
on("tasks", "g6_task_edges", "SELECT job_id, task_key, upstream_key FROM tasks WHERE upstream_key IS NOT NULL",
   inv.task_edges)
on("tasks", "g6_missing_upstreams", """SELECT job_id, task_key, upstream_key FROM tasks t
  WHERE upstream_key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM tasks k WHERE k.job_id = t.job_id AND k.task_key = t.upstream_key)""", inv.missing_upstreams)

# ---- listings ------------------------------------------------------------------------------------

on("storage", "s3_list_storage", "SELECT path, is_dir, file_size FROM storage WHERE starts_with(path, '/FileStore/')",
   lambda s: inv.list_storage(s, "/FileStore"))
on("storage", "s3_list_storage_limit", "SELECT path, is_dir, file_size FROM storage ORDER BY path LIMIT 100",
   lambda s: inv.list_storage(s, "/", 100))
on("storage", "s5_relative_files", """SELECT regexp_replace(path, '^/FileStore/', '') AS relative_path FROM storage
  WHERE starts_with(path, '/FileStore/') AND NOT is_dir""",
   lambda s: lineage.relative_files(s.filter(~F.col("is_dir")), "/FileStore"))
on("storage", "a2_with_count", "SELECT count(*) AS count FROM storage", inv.with_count)
NOTEBOOK = "path, coalesce(language, 'UNKNOWN') AS language, size, modified_at"
on_notebooks("s4_list_notebooks_direct", f"""SELECT {NOTEBOOK} FROM notebooks
  WHERE regexp_matches(path, '^/Workspace/Users/u3/proj2/[^/]+$')""",
             lambda n: inv.list_notebooks(n, "/Workspace/Users/u3/proj2"))
on_notebooks("s4_list_notebooks_recursive", f"SELECT {NOTEBOOK} FROM notebooks WHERE starts_with(path, '/Workspace/')",
             lambda n: inv.list_notebooks(n, "/Workspace", True))
on_notebooks("s4_list_notebooks_limit", f"SELECT {NOTEBOOK} FROM notebooks ORDER BY path LIMIT 100",
             lambda n: inv.list_notebooks(n, "/", True, 100))

# ---- the ten questions ------------------------------------------------------------------------------

on("jobs", "q1_count_jobs", "SELECT count(*) AS n_jobs FROM jobs", inv.count_jobs)
on("jobs", "q2_oldest_job", "SELECT job_id, created_time FROM jobs ORDER BY created_time, job_id LIMIT 1", inv.oldest_job)
on("jobs", "q3_count_named", "SELECT count(*) AS n_jobs FROM jobs WHERE lower(name) LIKE '%etl%'",
   lambda j: inv.count_named(j, "etl"))
on_notebooks("q4_count_notebooks", """SELECT count(*) AS n_notebooks FROM notebooks
  WHERE regexp_matches(path, '^/Workspace/Users/u1/proj1/[^/]+$')""",
             lambda n: inv.count_notebooks(n, "/Workspace/Users/u1/proj1"))
on_notebooks("q4_notebooks_per_folder", """SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_notebooks
  FROM notebooks GROUP BY ALL""", inv.notebooks_per_folder)
on_notebooks("q5_notebook_language", """SELECT path, coalesce(language, 'UNKNOWN') AS language FROM notebooks
  WHERE path = '/Workspace/Users/u3/proj3/nb_38.py'""",
             lambda n: inv.notebook_language(n, "/Workspace/Users/u3/proj3/nb_38.py"))
on("warehouses", "q6_count_warehouses", "SELECT count(*) AS n_warehouses FROM warehouses", inv.count_warehouses)
on("clusters", "q7_cluster_version", "SELECT cluster_id, spark_version FROM clusters WHERE cluster_id = 'c-99'",
   lambda c: inv.cluster_version(c, "c-99"))
on("tasks", "q8_task_count", "SELECT job_id, count(*) AS n_tasks FROM tasks GROUP BY ALL", inv.task_counts)
on(["jobs", "tasks"], "q10_busiest_creator", """SELECT creator_user_name, job_id, count(*) AS n_tasks
  FROM tasks JOIN jobs USING (job_id) GROUP BY ALL ORDER BY n_tasks DESC, job_id LIMIT 1""", inv.busiest_creator)

# ---- joins over paths ----------------------------------------------------------------------------------

STEM = r"regexp_replace(path, '([^/])\.[^./]+$', '\1')"


def _job_analysis(spark, sf_dir):
    analysis = lineage.one_per_stem(code_corpus(spark, sf_dir).select(
        paths.without_extension(F.col("path")).alias("stem"), "path",
        quick_workflow(F.col("content"), "sdk").alias("workflow_type"),
    )).drop("path")
    return inv.job_analysis(asset(spark, sf_dir, "jobs"), asset(spark, sf_dir, "tasks"), analysis)


QUERIES["j1_job_analysis"] = _job_analysis
ORACLE["j1_job_analysis"] = over(f"""SELECT t.job_id, t.task_key, t.target AS stem, j.name, a.workflow_type
  FROM (SELECT job_id, task_key, {TASK_TYPES} FROM tasks) t JOIN jobs j USING (job_id)
  LEFT JOIN (SELECT {STEM} AS stem, {fx.SDK_WORKFLOW} AS workflow_type FROM files) a ON a.stem = t.target
  WHERE t.type = 'notebook'""", FILES, "jobs", "tasks")

QUERIES["j7_nearest_config"] = lambda spark, sf_dir: lineage.nearest_config(
    code_corpus(spark, sf_dir), workspace_configs(spark, sf_dir))
ORACLE["j7_nearest_config"] = over("""SELECT path, arg_min(config_path, depth) AS config_path, min(depth) AS depth FROM (
    SELECT path, 0::BIGINT AS depth, regexp_replace(path, '/[^/]*$', '') AS dir FROM files
    UNION ALL SELECT path, 1, regexp_replace(path, '(/[^/]*){2}$', '') FROM files
    UNION ALL SELECT path, 2, regexp_replace(path, '(/[^/]*){3}$', '') FROM files) d
  LEFT JOIN (SELECT DISTINCT config_path FROM workspace_configs) c ON c.config_path = d.dir || '/databricks.yml'
  WHERE config_path IS NOT NULL GROUP BY path
  UNION ALL SELECT path, NULL, NULL FROM files WHERE regexp_replace(path, '/[^/]*$', '') || '/databricks.yml' NOT IN
      (SELECT config_path FROM workspace_configs)
    AND regexp_replace(path, '(/[^/]*){2}$', '') || '/databricks.yml' NOT IN (SELECT config_path FROM workspace_configs)
    AND regexp_replace(path, '(/[^/]*){3}$', '') || '/databricks.yml' NOT IN (SELECT config_path FROM workspace_configs)""",
    FILES, WORKSPACE_CONFIG_CTE)
QUERIES["w3_pick_nearest"] = lambda spark, sf_dir: lineage.nearest_config(
    code_corpus(spark, sf_dir), workspace_configs(spark, sf_dir)).groupBy("depth").agg(F.count("*").alias("n_files"))
ORACLE["w3_pick_nearest"] = over(
    "SELECT depth, count(*) AS n_files FROM (" + ORACLE["j7_nearest_config"].split("\nSELECT path, arg_min", 1)[1].join(
        ["SELECT path, arg_min", ""]) + ") GROUP BY depth", FILES, WORKSPACE_CONFIG_CTE)

CALLS = f"calls AS MATERIALIZED ({fx.numbered(fx.found(rules.NOTEBOOK_CALL), 'callee')})"
CALL_EDGES = CALLS + r""",
edges AS (
  SELECT path, ordinal, callee, CASE
    WHEN starts_with(callee, '/') THEN callee
    WHEN starts_with(callee, './') THEN regexp_replace(path, '/[^/]*$', '') || substring(callee, 2)
    WHEN starts_with(callee, '../') THEN regexp_replace(path, '(/[^/]*){2}$', '') || substring(callee, 3)
    END AS resolved FROM calls)"""
on_files("j8_call_edges", rf"""SELECT e.path, e.ordinal, e.callee, f.path AS callee_path FROM edges e
  LEFT JOIN (SELECT path, {STEM} AS stem FROM files) f ON f.stem = e.resolved""",
         lambda f: lineage.call_edges(f), CALL_EDGES)
on_files("j9_lineage_edges", """SELECT path, direction, table_name,
    coalesce(CASE WHEN direction = 'input' THEN n_writers ELSE n_readers END, 0) AS n_counterparts
  FROM refs JOIN (SELECT table_name, count(*) FILTER (direction = 'output') AS n_writers,
    count(*) FILTER (direction = 'input') AS n_readers FROM refs GROUP BY ALL) USING (table_name)""",
         lineage.lineage_edges, fx.PYTHON_REFS)
on_files("j9_lineage_tables", """SELECT table_name, count(*) FILTER (direction = 'output') AS n_writers,
    count(*) FILTER (direction = 'input') AS n_readers,
    count(*) FILTER (direction = 'output') * count(*) FILTER (direction = 'input') AS n_edges
  FROM refs GROUP BY ALL""", lineage.lineage_tables, fx.PYTHON_REFS)

# ---- scalar functions over typed sources ------------------------------------------------------------------

IS_NUMBER = r"regexp_matches(source, '^\s*[+-]?[0-9]+(_[0-9]+)*\s*$')"
SOURCE_TYPE = f"""CASE WHEN regexp_matches(source, '^[0-9]+$') THEN 'job'
  WHEN starts_with(source, '/Workspace') OR starts_with(source, '/Repos') THEN 'workspace'
  WHEN starts_with(source, '/') OR starts_with(source, './') OR starts_with(source, '..') THEN 'local'
  WHEN {IS_NUMBER} THEN 'job' ELSE 'workspace' END"""
on("sources", "p6_source_type", f"SELECT source_id, {SOURCE_TYPE} AS source_type FROM sources",
   lambda s: s.select("source_id", paths.source_type(F.col("source")).alias("source_type")))
on("sources", "f8_job_id", f"""SELECT source_id, CASE WHEN {IS_NUMBER} THEN CAST(replace(trim(source), '_', '') AS BIGINT)
  END AS job_id FROM sources""", lambda s: s.select("source_id", paths.job_id(F.col("source")).alias("job_id")))
on("sources", "f1_bundle_name", f"""SELECT source_id, CASE WHEN {SOURCE_TYPE} = 'job' THEN 'job-' || source || '-bundle'
  ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(
    rtrim(source, '/'), '[^/]*$', 0), '([^.])\\.[^.]+$', '\\1')), '[_\\s]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'),
    '-'), ''), 'bundle') END AS bundle_name FROM sources""",
   lambda s: s.select("source_id", paths.bundle_name(F.col("source"), paths.source_type(F.col("source"))).alias("bundle_name")))
on("sources", "f6_path_arithmetic", """SELECT source_id, regexp_replace(source, '/[^/]*$', '') AS parent,
    '/Workspace/Users/me@x.org/bundles/' || CAST(source_id AS VARCHAR) AS own_upload,
    rtrim(source, '/') || '/b' AS given_upload FROM sources WHERE source <> ''""",
   lambda s: s.filter("source <> ''").select(
       "source_id", paths.parent_dir(F.col("source")).alias("parent"),
       paths.upload_path(F.lit(""), F.lit("me@x.org"), F.col("source_id").cast("string")).alias("own_upload"),
       paths.upload_path(F.col("source"), F.lit("me@x.org"), F.lit("b")).alias("given_upload")))
on("configs", "f6_bundle_dir", "SELECT path, regexp_replace(path, '/[^/]*$', '') AS bundle_dir FROM configs",
   lambda c: c.select("path", paths.bundle_dir(F.col("path")).alias("bundle_dir")))
on("qa", "f12_first_non_empty", "SELECT qa_id, coalesce(nullif(actual, ''), nullif(error, ''), 'auto') AS value FROM qa",
   lambda q: q.select("qa_id", tx.first_non_empty(F.col("actual"), F.col("error"), F.lit("auto")).alias("value")))
on("jobs", "f9_to_record", "SELECT job_id, name AS name_value, creator_user_name AS creator_value FROM jobs",
   lambda j: j.withColumn("record", tx.to_record(
       F.array(F.lit("name"), F.lit("creator")), F.array("name", "creator_user_name"))).select(
       "job_id", F.col("record")["name"].alias("name_value"), F.col("record")["creator"].alias("creator_value")))
on_files("f5_to_b64", "SELECT path, base64(encode(content)) AS encoded FROM files",
         lambda f: f.select("path", tx.to_b64(F.col("content")).alias("encoded")))
on_files("s2_decode_export", "SELECT path, len(content) AS n_chars, md5(content) AS digest FROM files",
         lambda f: lineage.decode_export(
             f.select("path", F.when(F.col("doc_id") % 3 == 0, F.col("content")).otherwise(
                 tx.to_b64(F.col("content"))).alias("content"))).select(
             "path", F.char_length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest")))
on_files("w6_cut", """SELECT path, substring(content, 1, 200) AS head, right(content, 1000) AS tail,
    CASE WHEN len(content) > 80 THEN substring(content, 1, 80) || '...' ELSE content END AS after_cut,
    CASE WHEN len(content) > 100 THEN substring(content, 1, 97) || '...' ELSE content END AS inside_cut FROM files""",
         lambda f: f.select(
             "path", tx.cut(F.col("content"), 200).alias("head"), tx.cut(F.col("content"), 1000, "tail").alias("tail"),
             tx.cut(F.col("content"), 80, ellipsis="after").alias("after_cut"),
             tx.cut(F.col("content"), 100, ellipsis="inside").alias("inside_cut")))
on_files("w5_first_n", f"""SELECT path, array_to_string(({fx.found(rules.IMPORT_WORD)})[1:3], ',') AS first_words
  FROM files""", lambda f: f.select("path", F.array_join(tx.first_n(
      tx.find_all(F.col("content"), rules.IMPORT_WORD), 3), ",").alias("first_words")))
QUERIES["f11_arithmetic"] = lambda spark, sf_dir: lineage.arithmetic(asset(spark, sf_dir, "transactions"))
ORACLE["f11_arithmetic"] = over("""SELECT customer_id, transaction_id, amount + customer_id AS added,
    amount - customer_id AS subtracted, amount * customer_id AS multiplied,
    CASE WHEN customer_id <> 0 THEN amount / customer_id END AS divided,
    CASE WHEN amount >= 0 THEN sqrt(amount) END AS root, pow(customer_id, 2) AS raised FROM transactions""", "transactions")
