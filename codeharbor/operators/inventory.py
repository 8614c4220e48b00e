"""Queries over jobs, tasks, notebooks, clusters, warehouses and storage listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions.text import with_default
from codeharbor.plans.skew import lookup_join

# rule set -> kind -> public fields, as (column, public name) where the names differ
ASSET_FIELDS = {
    "mcp": {
        "job": ["job_id", "name", "created_time", "creator_user_name"],
        "warehouse": ["warehouse_id", "name", "size", "state", "auto_stop_mins"],
        "notebook": ["path", "language", "size", "modified_at"],
        "storage": ["path", "is_dir", "file_size"],
        "cluster": [
            "cluster_id", "cluster_name", "spark_version", "node_type_id", "driver_node_type_id", "num_workers",
            "autotermination_minutes", "spark_conf", "spark_env_vars", "enable_elastic_disk", "custom_tags",
            "init_scripts", "cluster_source", "state",
        ],
    },
    "sdk": {
        "job": ["job_id", "name", ("creator_user_name", "creator")],
        "warehouse": [("warehouse_id", "id"), "name", "size", "state"],
        "notebook": ["path", "language"],
        "storage": ["path", "is_dir", ("file_size", "size")],
        "cluster": ["cluster_id", ("cluster_name", "name"), "spark_version", "node_type_id", "num_workers", "state"],
    },
}
UNKNOWN_WHEN_MISSING = {("warehouse", "state"), ("notebook", "language")}
EMPTY_WHEN_MISSING = {"spark_conf", "spark_env_vars", "custom_tags", "init_scripts"}


# ---- listings -----------------------------------------------------------------------------


def name_matches(name: Column, name_filter: str | None) -> Column:
    """Case-insensitive substring; a row without a name never matches a filter."""
    if not name_filter:
        return F.lit(True)
    return F.coalesce(F.contains(F.lower(name), F.lit(name_filter.lower())), F.lit(False))


def top_n(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first n rows by key: a heap per task, then one merge, never a full sort."""
    return rows if n is None else rows.orderBy(key).limit(n)


def list_jobs(
    jobs: DataFrame, limit: int | None = None, name_filter: str | None = None, ruleset: str = "mcp"
) -> DataFrame:
    """The filter comes first: the limit counts matches only."""
    matching = jobs.filter(name_matches(F.col("name"), name_filter))
    return top_n(project_assets(matching, "job", ruleset), "job_id", limit)


def project_assets(rows: DataFrame, kind: str, ruleset: str = "mcp") -> DataFrame:
    """The public fields of an asset kind. A missing warehouse state or notebook language reads
    UNKNOWN, a missing map or list is empty."""
    public = []
    for field in ASSET_FIELDS[ruleset][kind]:
        name, alias = (field, field) if isinstance(field, str) else field
        value = F.col(name)
        if (kind, name) in UNKNOWN_WHEN_MISSING:
            value = with_default(value, "UNKNOWN")
        elif name in EMPTY_WHEN_MISSING:
            empty = F.array() if name == "init_scripts" else F.create_map()
            value = F.coalesce(value, empty.cast(rows.schema[name].dataType))
        public.append(value.alias(alias))
    return rows.select(*public)


def list_warehouses(warehouses: DataFrame, limit: int | None = None) -> DataFrame:
    return top_n(project_assets(warehouses, "warehouse"), "warehouse_id", limit)


def _below(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.startswith(path, F.lit(prefix))


def _is_child(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.instr(F.substring(path, len(prefix) + 1, 2147483647), "/") == 0


def list_notebooks(
    notebooks: DataFrame, path: str = "/", recursive: bool = False, limit: int | None = None
) -> DataFrame:
    """Notebooks under a path; without `recursive` only its direct children.

    The prefix test is a plain startsWith, so Parquet row groups outside the folder are skipped.
    """
    rows = notebooks.filter(_below(F.col("path"), path))
    if not recursive:
        rows = rows.filter(_is_child(F.col("path"), path))
    return top_n(project_assets(rows, "notebook"), "path", limit)


def notebooks_per_folder(notebooks: DataFrame) -> DataFrame:
    """(folder, n_notebooks): the direct-children count of every folder at once."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return notebooks.groupBy(folder).agg(F.count("*").alias("n_notebooks"))


def list_storage(storage: DataFrame, prefix: str = "/", limit: int | None = None) -> DataFrame:
    return top_n(project_assets(storage.filter(_below(F.col("path"), prefix)), "storage"), "path", limit)


def with_count(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are."""
    return rows.agg(F.count("*").alias("count"))


# ---- lookups --------------------------------------------------------------------------------


def found_or_error(rows: DataFrame, key: str, value, kind: str) -> DataFrame:
    """The rows with this key, or one row that only holds an error text.

    The key test reaches the scan in both branches.
    """
    hit = rows.filter(F.col(key) == F.lit(value))
    missing = hit.agg(F.count("*").alias("n")).filter("n = 0").select(
        *[F.lit(None).cast(field.dataType).alias(field.name) for field in hit.schema],
        F.lit(f"{kind} {value} not found").alias("error"),
    )
    return hit.withColumn("error", F.lit(None).cast("string")).unionByName(missing)


def get_job(jobs: DataFrame, job_id: int) -> DataFrame:
    """The job's settings, or an error row. Its tasks are `job_tasks`."""
    columns = [*ASSET_FIELDS["mcp"]["job"], "max_concurrent_runs", "timeout_seconds"]
    return found_or_error(jobs.select(*columns), "job_id", job_id, "job")


def job_tasks(tasks: DataFrame, job_id: int | None = None) -> DataFrame:
    """(job_id, task_key, type, target, depends_on) of one job, or of every job."""
    rows = tasks if job_id is None else tasks.filter(F.col("job_id") == job_id)
    return rows.select("job_id", "task_key", *task_columns(), "depends_on")


def get_cluster(clusters: DataFrame, cluster_id: str, ruleset: str = "mcp") -> DataFrame:
    return found_or_error(project_assets(clusters, "cluster", ruleset), "cluster_id", cluster_id, "cluster")


# ---- tasks ------------------------------------------------------------------------------------


def task_columns() -> list[Column]:
    """type and target of a task, read from its settings document."""
    settings = F.parse_json("settings")

    def field(path: str) -> Column:
        return F.try_variant_get(settings, path, "string")

    notebook, wheel, script = (
        field("$.notebook_task.notebook_path"),
        field("$.python_wheel_task.package_name"),
        field("$.spark_python_task.python_file"),
    )
    kind = (
        F.when(notebook.isNotNull(), "notebook")
        .when(wheel.isNotNull(), "python_wheel")
        .when(script.isNotNull(), "spark_python")
    )
    return [kind.alias("type"), F.coalesce(notebook, wheel, script).alias("target")]


def task_type(tasks: DataFrame, ruleset: str = "mcp") -> DataFrame:
    """(job_id, task_key, type, target); the sdk rule set knows notebook, python and other."""
    typed = tasks.select("job_id", "task_key", *task_columns())
    if ruleset == "mcp":
        return typed
    kind = (
        F.when(F.col("type") == "notebook", "notebook").when(F.col("type") == "python_wheel", "python").otherwise("other")
    )
    return typed.select(
        "job_id", "task_key", kind.alias("type"),
        F.when(F.col("type") == "notebook", F.col("target")).alias("target"),
    )


def notebook_paths(tasks: DataFrame) -> DataFrame:
    """The tasks that run a notebook, with its path as `stem`."""
    may_have = F.contains("settings", F.lit("notebook_task"))  # parse only documents that can hold it
    path = F.when(may_have, F.get_json_object("settings", "$.notebook_task.notebook_path"))
    return tasks.withColumn("stem", path).filter(F.col("stem").isNotNull())


def task_edges(tasks: DataFrame) -> DataFrame:
    """(job_id, task_key, upstream_key), one row per dependency."""
    return tasks.select("job_id", "task_key", F.explode("depends_on").alias("upstream_key"))


def missing_upstreams(tasks: DataFrame) -> DataFrame:
    """Edges that point to a task the job does not have.

    Both sides shuffle once on (job_id, task key), which no job can overload.
    """
    known = tasks.select("job_id", F.col("task_key").alias("upstream_key")).distinct()
    return task_edges(tasks).join(known, ["job_id", "upstream_key"], "left_anti")


def job_analysis(jobs: DataFrame, tasks: DataFrame, analysis: DataFrame) -> DataFrame:
    """Every notebook task with its job's name and its notebook's analysis, NULL when unknown.

    `analysis` holds one row per `stem` (a notebook path without extension). A notebook many
    tasks share, or a job with very many tasks, is spread by salting its hot keys only.
    """
    notebook_tasks = notebook_paths(tasks).select("job_id", "task_key", "stem")
    named = lookup_join(
        notebook_tasks, jobs.select("job_id", "name"), "job_id", ["task_key", "stem"], "inner", keys_from=tasks
    )
    return lookup_join(named, analysis, "stem", ["job_id", "task_key"], "left", keys_from=notebook_tasks)


# ---- the ten questions ---------------------------------------------------------------------------


def count_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("n_jobs"))


def oldest_job(jobs: DataFrame) -> DataFrame:
    """The job created first; the smallest id decides a tie."""
    first = F.min(F.struct("created_time", "job_id"))
    return jobs.agg(first.alias("first")).select("first.job_id", "first.created_time")


def count_named(jobs: DataFrame, word: str) -> DataFrame:
    return jobs.agg(F.count_if(name_matches(F.col("name"), word)).alias("n_jobs"))


def count_notebooks(notebooks: DataFrame, path: str) -> DataFrame:
    return list_notebooks(notebooks, path).agg(F.count("*").alias("n_notebooks"))


def notebook_language(notebooks: DataFrame, path: str) -> DataFrame:
    return project_assets(notebooks, "notebook").filter(F.col("path") == path).select("path", "language")


def count_warehouses(warehouses: DataFrame) -> DataFrame:
    return warehouses.agg(F.count("*").alias("n_warehouses"))


def cluster_version(clusters: DataFrame, cluster_id: str) -> DataFrame:
    return clusters.filter(F.col("cluster_id") == cluster_id).select("cluster_id", "spark_version")


def task_counts(tasks: DataFrame, job_id: int | None = None) -> DataFrame:
    """(job_id, n_tasks) for one job or, by default, for every job."""
    rows = tasks if job_id is None else tasks.filter(F.col("job_id") == job_id)
    return rows.groupBy("job_id").agg(F.count("*").alias("n_tasks"))


def busiest_creator(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Creator of the job with the most tasks; the smallest id decides a tie.

    Tasks are counted before the join, so the join sees one row per job.
    """
    counted = task_counts(tasks).join(jobs.select("job_id", "creator_user_name"), "job_id")
    best = F.max(F.struct("n_tasks", (-F.col("job_id")).alias("minus_id"), "creator_user_name"))
    return counted.agg(best.alias("b")).select(
        F.col("b.creator_user_name").alias("creator_user_name"),
        (-F.col("b.minus_id")).alias("job_id"),
        F.col("b.n_tasks").alias("n_tasks"),
    )
