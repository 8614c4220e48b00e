"""Config texts: rendering, rule-based lints, run logs and the advice drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import any_of, cut, first_n, strip
from codeharbor.functions.yaml_json import yaml_to_json
from codeharbor.operators.extraction import library_names
from codeharbor.operators.classify import quick_workflow
from codeharbor.operators.inventory import notebook_paths
from codeharbor.operators.lineage import one_per_stem
from codeharbor.plans.skew import lookup_join

CONFIG_SCHEMA = """bundle struct<name: string>,
  resources struct<jobs: map<string, struct<name: string, existing_cluster_id: string, timeout_seconds: string,
    max_retries: string, email_notifications: string, tasks: array<struct<task_key: string,
    notebook_task: struct<base_parameters: map<string, string>>>>>>>,
  targets map<string, struct<mode: string>>"""


def _texts(*conditions: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in conditions]))


# ---- lints -----------------------------------------------------------------------------------


def practice_columns(content: Column, target: Column) -> list[Column]:
    """score (100 minus the weight of every missing practice, at least 0) and suggestions."""
    no_stop = ~F.contains(content, F.lit("autotermination_minutes"))
    no_spot = (target == "dev") & ~F.contains(F.lower(content), F.lit("spot"))
    no_mail = ~F.contains(content, F.lit("email_notifications"))
    # fixed values: the weights
    score = F.lit(100) - F.when(no_stop, 10).otherwise(0) - F.when(no_spot, 5).otherwise(0) - F.when(no_mail, 10).otherwise(0)
    return [
        F.greatest(F.lit(0), score).cast("long").alias("score"),
        _texts(
            (no_stop, rules.PRACTICE_AUTOTERMINATION), (no_spot, rules.PRACTICE_SPOT), (no_mail, rules.PRACTICE_EMAIL)
        ).alias("suggestions"),
    ]


def secret_issues(content: Column) -> Column:
    """Issues by the first occurrence of each key only, looking 50 characters on."""

    def bare(key: str) -> Column:
        at = F.instr(F.lower(content), key)
        return (at > 0) & ~F.contains(F.substring(content, at, F.lit(50)), F.lit("${"))

    return _texts((bare("password:"), rules.SECRET_PASSWORD), (bare("api_key:"), rules.SECRET_API_KEY))


def lint_practices(configs: DataFrame, target: Column) -> DataFrame:
    """(path, score, suggestions)."""
    return configs.select("path", *practice_columns(F.col("content"), target))


def lint_secrets(configs: DataFrame) -> DataFrame:
    """(path, passed, issues)."""
    found = configs.select("path", secret_issues(F.col("content")).alias("issues"))
    return found.select("path", (F.size("issues") == 0).alias("passed"), "issues")


def lint_config(configs: DataFrame, target: Column) -> DataFrame:
    """(path, passed, findings): structural rules over the parsed config.

    Parsing YAML is the one Python step; the rules run on the typed struct.
    """
    parsed = configs.select("path", target.alias("target"), yaml_to_json("content").alias("json")).withColumn(
        "c", F.from_json("json", CONFIG_SCHEMA)
    )
    jobs = F.coalesce(F.map_values("c.resources.jobs"), F.array())
    modes = F.col("c.targets")

    def some_job(test) -> Column:
        return F.exists(jobs, test)

    def leaks(job: Column) -> Column:
        return F.exists(
            F.coalesce(job["tasks"], F.array()),
            lambda task: F.exists(
                F.coalesce(F.map_entries(task["notebook_task"]["base_parameters"]), F.array()),
                lambda p: F.rlike(p["key"], F.lit(rules.SECRET_KEYS)) & ~F.contains(p["value"], F.lit("${")),
            ),
        )

    read = F.col("json").isNotNull()
    name = F.col("c.bundle.name")
    errors = [
        (~read, rules.LINT_BAD_YAML),
        (read & name.isNull(), rules.LINT_NO_NAME),
        (read & (F.size(jobs) == 0), rules.LINT_NO_JOBS),
        (some_job(lambda j: j["name"].isNull()), rules.LINT_NO_JOB_NAME),
        (some_job(lambda j: F.size(F.coalesce(j["tasks"], F.array())) == 0), rules.LINT_NO_TASKS),
        (some_job(leaks), rules.LINT_SECRETS),
    ]
    advice = [
        (name.isin(rules.VAGUE_NAMES), rules.LINT_VAGUE_NAME),
        (
            (F.col("target") == "prod") & some_job(lambda j: j["existing_cluster_id"].isNotNull()),
            rules.LINT_EXISTING_CLUSTER,
        ),
        (some_job(lambda j: j["email_notifications"].isNull()), rules.LINT_NO_EMAIL),
        (some_job(lambda j: j["timeout_seconds"].isNull()), rules.LINT_NO_TIMEOUT),
        (some_job(lambda j: j["max_retries"].isNull()), rules.LINT_NO_RETRIES),
        (F.coalesce(modes["prod"]["mode"] != "production", F.lit(False)), rules.LINT_PROD_MODE),
    ]
    return parsed.select("path", _texts(*errors).alias("errors"), _texts(*advice).alias("advice")).select(
        "path", (F.size("errors") == 0).alias("passed"), "errors", "advice"
    )


# ---- run logs ------------------------------------------------------------------------------------


def _marked(stderr: Column, mark: str) -> Column:
    """Texts after `mark` on the lines that start with it."""
    lines = F.transform(F.split(stderr, "\n"), strip)
    return F.transform(
        F.filter(lines, lambda line: F.startswith(line, F.lit(mark))),
        lambda line: strip(F.substring(line, len(mark) + 1, 2147483647)),
    )


def cli_info(stdout: Column) -> Column:
    """struct(name, target, host, user, path) from 'Key: value' lines; the last line of a key wins."""

    def value(key: str) -> Column:
        found = F.regexp_extract_all(stdout, F.lit(rf"(?md)^{key}:(.*)$"), F.lit(1))
        return F.when(F.contains(stdout, F.lit("Name:")), strip(F.try_element_at(found, F.lit(-1)))).alias(key.lower())

    return F.struct(*[value(key) for key in ("Name", "Target", "Host", "User", "Path")])


def parse_cli_runs(runs: DataFrame, tail: int | None = None) -> DataFrame:
    """Errors, warnings, verdict, info and the output of every run, its last `tail` characters if given."""
    passed = (F.col("return_code") == 0) | F.contains("stdout", F.lit(rules.SUCCESS_PHRASE))
    parsed = runs.select(
        "run_id", "bundle_path", "target", "return_code",
        passed.alias("validation_passed"),
        _marked(F.col("stderr"), "Error:").alias("errors"),
        _marked(F.col("stderr"), "Warning:").alias("warnings"),
        cli_info(F.col("stdout")).alias("bundle_info"),
        cut(F.col("stdout"), tail, "tail").alias("stdout_tail"),
        cut(F.col("stderr"), tail, "tail").alias("stderr_tail"),
    )
    return parsed.withColumns(
        {
            "total_errors": F.size("errors").cast("long"),
            "total_warnings": F.size("warnings").cast("long"),
        }
    )


def validation_rows(runs: DataFrame, ruleset: str = "mcp") -> DataFrame:
    """The short outcome row: here the return code alone decides."""
    passed = (F.col("return_code") == 0)
    if ruleset == "sdk":
        return runs.select(
            "run_id", passed.alias("valid"), "bundle_path", "target",
            F.when(F.col("stdout") != "", strip(F.col("stdout"))).otherwise(strip(F.col("stderr"))).alias("output"),
        )
    return runs.select(
        "run_id", passed.alias("validation_passed"), "bundle_path",
        F.col("target").alias("target_environment"),
        F.concat(F.lit("databricks bundle validate -t "), F.col("target")).alias("command"),
        strip(F.col("stdout")).alias("stdout"),
        F.when(F.col("stderr") != "", strip(F.col("stderr"))).alias("stderr"),
        "return_code",
    )


def validation_failures(failures: DataFrame) -> DataFrame:
    """The full row of a validation that could not be run, from failures(run_id, error): not passed, one
    error, no score, the error as security issue and as the action to take."""
    none = F.array().cast("array<string>")
    error = F.array("error")
    return failures.select(
        "run_id", F.lit(False).alias("validation_passed"),
        F.struct(F.lit(1).alias("total_errors"), F.lit(0).alias("total_warnings")).alias("validation_summary"),
        error.alias("errors"), none.alias("warnings"),
        F.struct(F.lit(0).alias("score"), none.alias("suggestions")).alias("best_practices"),
        F.struct(F.lit(False).alias("passed"), error.alias("issues")).alias("security_checks"),
        F.struct(
            error.alias("immediate_actions"), none.alias("improvements"), F.array(F.lit(rules.RETRY_STEP)).alias("next_steps")
        ).alias("recommendations"),
    )


def validate(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Run outcome beside the lints of the run's config; NULL lints where there is no config."""
    content = F.col("content")
    linted = configs.select(
        "path", *practice_columns(content, F.col("target")), secret_issues(content).alias("issues")
    ).withColumn("security_passed", F.size("issues") == 0)
    path = F.concat("bundle_path", F.lit("/" + rules.CONFIG_FILE)).alias("path")
    return lookup_join(parse_cli_runs(runs).select("*", path), linted, "path", ["run_id"], "left", keys_from=runs.select(path))


# ---- advice ------------------------------------------------------------------------------------


def _when_texts(condition: Column, texts: list[str]) -> Column:
    full = F.array(*[F.lit(text) for text in texts])
    return F.when(condition, full).otherwise(F.array().cast("array<string>"))


def _bullets(values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit("- "), v))


def advice(validated: DataFrame, ruleset: str = "service", first: int | None = None) -> DataFrame:
    """(run_id, immediate_actions, improvements, next_steps) of validated runs.

    Errors and suggestions are all told, or the `first` of either.
    """
    has_errors, has_warnings = F.size("errors") > 0, F.size("warnings") > 0
    none = F.array().cast("array<string>")
    if ruleset == "service":
        texts = rules.SERVICE_ADVICE
        actions = F.concat(
            _when_texts(has_errors, texts["errors"]),
            _bullets(first_n(F.col("errors"), first)),
            F.coalesce(F.col("issues"), none),
        )
        improvements = F.concat(
            _when_texts(has_warnings, texts["warnings"]),
            _when_texts(F.coalesce(F.col("score") < 80, F.lit(False)), texts["score"]),
            _bullets(first_n(F.coalesce(F.col("suggestions"), none), first)),
        )
    else:
        texts = rules.TOOL_ADVICE
        score = F.coalesce(F.col("score"), F.lit(0))
        actions = F.concat(
            _when_texts(has_errors, texts["errors"]),
            _when_texts(~F.coalesce(F.col("security_passed"), F.lit(False)), texts["security"]),
        )
        improvements = F.concat(
            _when_texts(score < 80, texts["score"]),
            _when_texts(score < 60, texts["low_score"]),
            _when_texts(has_warnings, texts["warnings"]),
        )
    steps = F.concat(
        _when_texts(F.col("validation_passed"), texts["passed"]),
        _when_texts(~F.col("validation_passed"), texts["failed"]),
    )
    return validated.select(
        "run_id", actions.alias("immediate_actions"), improvements.alias("improvements"), steps.alias("next_steps")
    )


# ---- bundles ------------------------------------------------------------------------------------


def bundle_files(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle_name, stem, workflow_type, libraries, uses_mlflow, uses_streaming, error).

    One row per stem of a bundle, described by the file with the smallest path; a stem that is not
    in the corpus keeps its row with an error.
    """
    content = F.col("content")
    analysed = one_per_stem(files.select(
        "path",
        F.regexp_replace("path", r"([^/])\.[^./]+$", "$1").alias("stem"),
        quick_workflow(content, "sdk").alias("workflow_type"),
        library_names(content, "sdk").alias("libraries"),
        any_of(F.lower(content), rules.STREAMING_WORDS).alias("uses_streaming"),
    )).drop("path").withColumn("uses_mlflow", F.array_contains("libraries", "mlflow"))
    return lookup_join(bundles, analysed, "stem", ["bundle_name"], "left", keys_from=bundles).withColumn(
        "error", F.when(F.col("workflow_type").isNull(), F.lit("Could not analyze file"))
    )


def bundles_from_jobs(tasks: DataFrame) -> DataFrame:
    """(bundle_name, stem): the distinct notebooks of every job."""
    name = F.concat(F.lit("job-"), F.col("job_id"), F.lit("-bundle")).alias("bundle_name")
    return notebook_paths(tasks).select(name, "stem").distinct()


def _typed_counts(members: DataFrame) -> DataFrame:
    """Members per (bundle, type), so a bundle of any size reaches the next step as a few rows."""
    return members.groupBy("bundle_name", "workflow_type").agg(F.count("*").alias("n"), F.count("error").alias("failed"))


def _dominant() -> Column:
    """Over typed counts: the most frequent type, smallest name on a tie, 'etl' if there is none."""
    ranked = F.struct((-F.col("n")).alias("minus_n"), "workflow_type")
    best = F.min(F.when(F.col("workflow_type").isNotNull(), ranked))
    return F.coalesce(best["workflow_type"], F.lit("etl")).alias("dominant_workflow")


def dominant_workflow(members: DataFrame) -> DataFrame:
    """(bundle_name, dominant_workflow)."""
    return _typed_counts(members).groupBy("bundle_name").agg(_dominant())


def bundle_pattern(members: DataFrame) -> DataFrame:
    """(bundle_name, n_files, pattern): ml > multi_stage > streaming > simple."""
    known = F.coalesce(F.col("uses_mlflow"), F.lit(False)), F.coalesce(F.col("uses_streaming"), F.lit(False))
    totals = members.groupBy("bundle_name").agg(
        F.count("*").alias("n_files"), F.bool_or(known[0]).alias("ml"), F.bool_or(known[1]).alias("streaming")
    )
    return totals.select(
        "bundle_name", "n_files",
        F.when(F.col("ml"), "ml").when(F.col("n_files") > 1, "multi_stage").when(F.col("streaming"), "streaming")
        .otherwise("simple").alias("pattern"),
    )


def bundle_context(members: DataFrame, host: str = "https://your-workspace.example.com") -> DataFrame:
    """One row per bundle: counts, dominant workflow, host. The analyses are `bundle_analyses`."""
    totals = _typed_counts(members).groupBy("bundle_name").agg(
        F.sum("n").alias("n_files"), F.sum("failed").alias("n_failed"), _dominant()
    )
    return totals.select(
        "bundle_name", "n_files", "n_failed", "dominant_workflow",
        F.concat(F.lit("./"), F.col("bundle_name")).alias("output_path"),
        F.lit(host).alias("workspace_host"),
        F.concat(F.col("n_files").cast("string"), F.lit(" files analyzed")).alias("analysis_note"),
    )


def bundle_analyses(members: DataFrame) -> DataFrame:
    """(bundle_name, stem, analysis): each file's analysis as JSON, one row per file, so a bundle
    of any size stays spread over tasks."""
    found = F.to_json(F.struct("workflow_type", "libraries", "uses_mlflow"))
    failed = F.to_json(F.struct("error"))
    return members.select(
        "bundle_name", "stem", F.when(F.col("error").isNull(), found).otherwise(failed).alias("analysis")
    )


def cluster_choice(kind: Column, preferred: Column, wants_serverless: Column) -> Column:
    """Compute for a task: serverless notebook, fetched job cluster, environment, or ask."""
    return (
        F.when(kind == "notebook", "serverless")
        .when(preferred.isNotNull(), "job_cluster")
        .when(wants_serverless, "environment")
        .otherwise("ask")
    )


# ---- rendering -----------------------------------------------------------------------------------


def render_cluster(clusters: DataFrame) -> DataFrame:
    """(cluster_id, job_cluster_yaml): a job-cluster snippet; spark conf lines in key order."""
    entries = F.array_sort(F.map_entries("spark_conf"))
    lines = F.transform(entries, lambda e: F.concat(F.lit("\n        "), e["key"], F.lit(': "'), e["value"], F.lit('"')))
    text = F.concat(
        F.lit("job_clusters:\n  - job_cluster_key: main_cluster\n    new_cluster:\n      spark_version: \""),
        F.col("spark_version"),
        F.lit('"\n      node_type_id: "'), F.col("node_type_id"),
        F.lit('"\n      num_workers: '), F.coalesce(F.col("num_workers"), F.lit(0)).cast("string"),
        F.when(
            F.col("autotermination_minutes") > 0,
            F.concat(F.lit("\n      autotermination_minutes: "), F.col("autotermination_minutes").cast("string")),
        ).otherwise(""),
        F.when(F.size("spark_conf") > 0, F.concat(F.lit("\n      spark_conf:"), F.array_join(lines, ""))).otherwise(""),
    )
    return clusters.select("cluster_id", text.alias("job_cluster_yaml"))


def _by_pattern(position: int) -> Column:
    value = F.lit(None).cast("string")
    for name, row in rules.BUNDLE_PATTERNS.items():
        value = F.when(F.col("pattern") == name, F.lit(str(row[position]))).otherwise(value)
    return value


def render_bundle(jobs: DataFrame, tasks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Config text of every job as ordered blocks (bundle_name, section, sort_key, text).

    Section 0 is the head, 1 one block per notebook task, 2 the targets; blocks joined in
    (section, sort_key) order are the file. No job's tasks are ever collected, so one huge job
    is just many rows.
    """
    named = patterns.join(
        jobs.select(F.concat(F.lit("job-"), F.col("job_id"), F.lit("-bundle")).alias("bundle_name")), "bundle_name"
    )
    head = F.concat(
        F.lit("bundle:\n  name: "), F.col("bundle_name"),
        F.lit("\nresources:\n  jobs:\n    "), _by_pattern(0),
        F.lit(":\n      name: ${bundle.name}-${bundle.target}\n      job_clusters:\n        - job_cluster_key: "),
        _by_pattern(1),
        F.lit('\n          new_cluster:\n            spark_version: "'), _by_pattern(2),
        F.lit('"\n            node_type_id: "'), _by_pattern(3),
        F.lit('"\n            num_workers: '), _by_pattern(4),
        F.lit("\n      tasks:\n"),
    )

    def block_at(section: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit("").alias("sort_key"), text.alias("text"))

    edge = named.select(
        "bundle_name", F.inline(F.array(block_at(0, head), block_at(2, F.lit(rules.TARGETS_BLOCK))))
    )
    notebook_tasks = notebook_paths(tasks).select(
        F.concat(F.lit("job-"), F.col("job_id"), F.lit("-bundle")).alias("bundle_name"),
        "task_key", "depends_on", F.col("stem").alias("notebook_path"),
    )
    keyed = lookup_join(
        notebook_tasks, named.select("bundle_name", _by_pattern(1).alias("cluster_key")), "bundle_name",
        ["task_key", "notebook_path"], "inner", keys_from=notebook_tasks,
    )
    needs = F.transform("depends_on", lambda key: F.concat(F.lit("{task_key: "), key, F.lit("}")))
    block = F.concat(
        F.lit("        - task_key: "), F.col("task_key"),
        F.when(F.size("depends_on") > 0, F.concat(F.lit("\n          depends_on: ["), F.array_join(needs, ", "), F.lit("]")))
        .otherwise(""),
        F.lit("\n          notebook_task:\n            notebook_path: "), F.col("notebook_path"),
        F.lit("\n          job_cluster_key: "), F.col("cluster_key"), F.lit("\n"),
    )
    body = keyed.select(
        "bundle_name", F.lit(1).alias("section"),
        F.concat_ws(" ", "task_key", "notebook_path").alias("sort_key"), block.alias("text"),
    )
    return edge.unionByName(body).withColumn("section", F.col("section").cast("long"))
