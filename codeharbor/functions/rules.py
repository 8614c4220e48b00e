"""Fixed values.

Every list, pattern and constant in this module is part of the result definition: changing
one changes answers. They are data; the logic that uses them lives in the operators.
"""

# --- fixed values: file-type markers -------------------------------------------------
NOTEBOOK_MARKERS = ["# Databricks notebook source", "# MAGIC"]
PYTHON_CELL_MARKERS = ["# COMMAND", "# MAGIC %python"]
SQL_CELL_MARKERS = ["# MAGIC %sql", "-- COMMAND"]
PYTHON_CLUES = ["import ", "from ", "def "]
SQL_CLUES = ["select", "create table"]
CELL_SEPARATORS = ["# COMMAND ----------", "-- COMMAND ----------"]
MAGIC_PREFIX = "# MAGIC "

# --- fixed values: workflow words (matched in lower-cased text) -----------------------
REPORT_WORDS = ["matplotlib", "plotly", "seaborn", "display(", ".plot(", "plt.", "sns.", "fig"]
ML_STAGES = {
    "training": ["fit", "train", "mllib", "sklearn", "tensorflow", "torch", "model.fit"],
    "evaluation": ["evaluate", "score", "predict", "accuracy_score", "f1_score"],
    "model_ops": ["register_model", "log_model", "save_model", "load_model"],
}
ETL_STAGES = {
    "read": ["spark.read", "spark.sql", "spark.table", "pd.read_"],
    "transform": ["withcolumn", "select", "filter", "groupby", "agg", "join"],
    "write": ["write.", ".save(", "saveastable", "insertinto", "to_csv", "to_parquet"],
}
DDL_WORDS = ["create table", "create view"]

# --- fixed values: import categories --------------------------------------------------
PLATFORM_MODULES = ["pyspark", "databricks", "dbutils", "delta", "mlflow"]
STANDARD_MODULES = [
    "os", "sys", "json", "datetime", "logging", "pathlib",
    "collections", "itertools", "re", "math", "random",
]
BUILT_IN_LIBRARIES = ["pyspark", "databricks"]
SIMPLE_LIBRARIES = [
    "pandas", "numpy", "sklearn", "tensorflow", "torch", "mlflow",
    "pyspark", "databricks", "matplotlib", "seaborn", "scipy",
]
SDK_LIBRARIES = ["pandas", "numpy", "sklearn", "tensorflow", "torch", "mlflow", "pyspark", "databricks"]

# --- fixed values: extraction patterns (no look-around, no back-references) -----------
# A possessive repeat of a group ("*+") matches the same here and keeps Java from recursing.
_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
NAME_2_3 = rf"{_NAME}(?:\.{_NAME}){{1,2}}"
NAME_1_N = rf"{_NAME}(?:\.{_NAME})*+"
TABLE_CALL = rf"""spark\.(?:table|read\.table)\s*\(\s*["']({NAME_2_3})["']"""
SQL_SOURCE = rf"(?i)(?:FROM|JOIN)\s+({NAME_2_3})"
TABLE_WRITE = (
    r"(?i)(?:saveAsTable|INSERT INTO|CREATE OR REPLACE TABLE|CREATE TABLE)"
    rf"""\s*\(?\s*["']?({NAME_2_3})"""
)
STORAGE_PATH = r"""["'](/(?:mnt|dbfs|FileStore)/[^"']+)["']"""
DELTA_HANDLE = r"delta\.tables\.DeltaTable\.(?:forPath|forName)\s*\([^)]+\)"
SQL_FILE_SOURCE = rf"(?i)(?:FROM|JOIN)\s+({NAME_1_N})"
SQL_FILE_TARGET = (
    r"(?i)(?:CREATE\s+(?:OR\s+REPLACE\s+)?TABLE|INSERT\s+INTO|MERGE\s+INTO)"
    rf"\s+({NAME_1_N})"
)
STATEMENT_REF = rf"(?i)(?:%s)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:TABLE\s+)?({NAME_1_N})"
SQL_DENY_WORDS = ["TABLE", "INTO", "FROM", "JOIN", "WHERE", "AS", "SELECT"]
IMPORT_WORD = rf"(?:from|import)\s+({_NAME})"
IMPORT_LINE = r"(?m)^\s*(?:from\s+([^\s]+)\s+)?import\s+([^\s,]+(?:\s*,\s*[^\s,]+)*+)"
NOTEBOOK_CALL = r"""dbutils\.notebook\.run\s*\(["']([^"']+)"""
WIDGET_ANY = r"""dbutils\.widgets\.\w+\(["']([^"']+)["']"""
WIDGET_NEW = (
    r"dbutils\.widgets\.(text|dropdown|combobox|multiselect)"
    r"""\s*\(\s*["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""
)
YAML_FENCE = r"(?s)```(?:yaml|yml)?\s*\n(.*?)```"
YAML_CLUES = ["bundle:", "resources:"]

# --- fixed values: platform features, any case, multi-line; name -> (pattern, groups) --
FEATURES = {
    "widgets": (r"dbutils\.widgets\.(text|dropdown|combobox|multiselect)\s*\([^)]+\)", 1),
    "notebook_run": (NOTEBOOK_CALL, 1),
    "spark_session": (r"spark\.(sql|read|write|table|createDataFrame)", 1),
    "delta_operations": (r"(delta|DeltaTable)\.(create|load|merge|update|delete)", 2),
    "mlflow_tracking": (r"mlflow\.(start_run|log_param|log_metric|log_model)", 1),
    "unity_catalog": (r"(main|hive_metastore|[a-zA-Z_]+)\.[a-zA-Z_]+\.[a-zA-Z_]+", 1),
    "dbfs_paths": (r"/(?:mnt|dbfs|FileStore)/[a-zA-Z0-9_/\-\.]+", 0),
    "cluster_config": (r"""spark\.conf\.(set|get)\s*\(["']([^"']+)""", 2),
    "magic_commands": (r"^%\s*(python|sql|scala|r|sh|md)\s*$", 1),
}
FEATURE_LIMIT = 10
# lower-case texts without which a pattern cannot match
FEATURE_NEEDLES = {
    "widgets": ["dbutils.widgets."],
    "notebook_run": ["dbutils.notebook.run"],
    "spark_session": ["spark."],
    "delta_operations": ["delta.", "deltatable."],
    "mlflow_tracking": ["mlflow."],
    "unity_catalog": ["."],
    "dbfs_paths": ["/mnt/", "/dbfs/", "/filestore/"],
    "cluster_config": ["spark.conf."],
    "magic_commands": ["%"],
}
WRITE_NEEDLES = ["saveastable", "insert into", "create or replace table", "create table"]

# --- fixed values: job recommendations by workflow -------------------------------------
# workflow -> (job_type, schedule, spark_version, node_type_id, num_workers)
RECOMMENDATIONS = {
    "ETL": ("scheduled_batch", "0 2 * * *", "13.3.x-scala2.12", "i3.xlarge", 2),
    "ML": ("ml_training", None, "13.3.x-ml-scala2.12", "g4dn.xlarge", 1),
    "reporting": ("scheduled_report", "0 8 * * 1-5", None, None, None),
}
DEFAULT_JOB_TYPE = "batch"
DEFAULT_NODE_TYPE = "i3.xlarge"

# --- fixed values: tool registry ---------------------------------------------------------
TOOL_PREFIXES = ["mcp__databricks-mcp__", "mcp__databricks__"]
SUBAGENT_TOOL = "Task"
CORE_TOOLS = [
    "health", "list_jobs", "get_job", "run_job", "list_notebooks", "export_notebook",
    "execute_dbsql", "list_warehouses", "list_dbfs_files", "get_cluster",
]
BUNDLE_TOOLS = ["analyze_notebook", "generate_bundle", "generate_bundle_from_job", "validate_bundle"]
WORKSPACE_TOOLS = ["upload_bundle", "run_bundle_command", "sync_workspace_to_local"]
ANALYST_TOOLS = [
    "get_job", "list_jobs", "list_notebooks", "export_notebook", "analyze_notebook", "get_cluster",
    "Read", "Grep", "Glob",
]
BUILDER_TOOLS = [
    "generate_bundle", "generate_bundle_from_job", "validate_bundle", "Write", "Edit", "Read", "Skill",
]
DEPLOYER_TOOLS = ["upload_bundle", "run_bundle_command", "sync_workspace_to_local"]
DESTRUCTIVE_TOOLS = {
    "mcp": ["run_job", "upload_bundle", "run_bundle_command"],
    "sdk": ["run_job", "upload_bundle", "run_bundle_command", "execute_dbsql"],
}
RATE_LIMITS = {"export_notebook": 10, "execute_dbsql": 50}
DEFAULT_RATE_LIMIT = 100
LANGUAGE_WORDS = ["Python", "JavaScript", "Java", "C++", "Go", "Rust", "Ruby"]

# --- fixed values: config lint texts ------------------------------------------------------
RETRY_STEP = "Fix the error and try again"
PRACTICE_AUTOTERMINATION = "Consider adding autotermination_minutes to clusters"
PRACTICE_SPOT = "Consider using spot instances in development"
PRACTICE_EMAIL = "Consider adding email notifications for job status"
SECRET_PASSWORD = "Potential hardcoded password detected"
SECRET_API_KEY = "Potential hardcoded API key detected"
SERVICE_ADVICE = {
    "errors": ["Fix validation errors before deployment"],
    "warnings": ["Review warnings for potential issues"],
    "score": ["Improve configuration based on best practices"],
    "passed": ["Bundle is ready for deployment", "Run 'databricks bundle deploy' to deploy"],
    "failed": ["Fix errors and re-validate", "Run 'databricks bundle validate' after fixes"],
}
TOOL_ADVICE = {
    "errors": [
        "Fix configuration errors before deployment",
        "Validate YAML syntax and required fields",
    ],
    "score": [
        "Review best practices suggestions to improve configuration quality",
        "Add missing monitoring and error handling configurations",
    ],
    "low_score": ["Consider significant refactoring to align with DAB best practices"],
    "security": [
        "Address security issues before deploying to production",
        "Review secret management and access control configurations",
    ],
    "passed": [
        "Bundle is ready for deployment",
        "Run 'databricks bundle validate' to confirm with Databricks CLI",
        "Consider testing in development environment first",
    ],
    "failed": [
        "Fix all errors listed in validation results",
        "Re-run validation after making corrections",
        "Test bundle configuration with 'databricks bundle validate'",
    ],
    "warnings": ["Review warnings for potential optimizations and improvements"],
}
SUCCESS_PHRASE = "Validation OK!"
CONFIG_FILE = "databricks.yml"
PLACEHOLDER_MARK = "UPDATE_WITH"
PASS_MARK = 80
EXPORT_FORMATS = ["SOURCE", "HTML", "JUPYTER", "DBC"]

# --- fixed values: bundle patterns ----------------------------------------------------------
STREAMING_WORDS = ["autoloader", "streaming", "readstream", "writestream"]
# pattern -> (job key, cluster key, spark_version, node_type_id, num_workers)
BUNDLE_PATTERNS = {
    "simple": ("main_job", "main", "16.4.x-scala2.12", "i3.xlarge", 2),
    "multi_stage": ("pipeline", "main", "13.3.x-scala2.12", "i3.xlarge", 4),
    "ml": ("ml_job", "ml", "14.3.x-ml-scala2.12", "i3.2xlarge", 4),
    "streaming": ("main_job", "main", "16.4.x-scala2.12", "i3.xlarge", 2),
}
TARGETS_BLOCK = """targets:
  dev:
    mode: development
    default: true
  prod:
    mode: production
"""
SECRET_KEYS = r"(?i)(?:password|api_key|secret|token)"

# --- fixed values: findings of the structural config lint ---------------------------------------
LINT_BAD_YAML = "YAML parsing error"
LINT_NO_NAME = "Bundle name is required"
LINT_VAGUE_NAME = "Use a descriptive bundle name"
LINT_NO_JOBS = "resources.jobs is required"
LINT_NO_JOB_NAME = "Job name is required"
LINT_NO_TASKS = "Job has no tasks"
LINT_EXISTING_CLUSTER = "Use job clusters, not existing clusters, in production"
LINT_NO_EMAIL = "Add email notifications for all jobs"
LINT_NO_TIMEOUT = "Set timeout_seconds"
LINT_NO_RETRIES = "Set max_retries"
LINT_SECRETS = "Hardcoded secrets found"
LINT_PROD_MODE = "Target prod should use mode production"
VAGUE_NAMES = ["my-bundle", "bundle", "test", "test-bundle"]
