"""Config lints, run logs, advice and rendering."""

import json

import pytest
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.operators import config as cfg

VALID = '''
bundle:
  name: customer-analytics
variables:
  catalog: {default: "${bundle.target}_catalog"}
resources:
  jobs:
    etl:
      name: etl-${bundle.target}
      email_notifications: {on_failure: ["a@example.com"]}
      timeout_seconds: 3600
      max_retries: 2
      tasks:
        - task_key: extract
          notebook_task: {notebook_path: ./extract.py}
targets:
  dev: {mode: development}
  prod: {mode: production}
'''
INVALID = "bundle:\n  description: x\nresources:\n  jobs:\n    bad:\n      tasks: []\n"
POOR = '''
resources:
  jobs:
    ferry:
      existing_cluster_id: harbour-7
      tasks:
        - {task_key: board, notebook_task: {notebook_path: ../ferry/board.py}}
        - {task_key: sail, notebook_task: {notebook_path: ../ferry/sail.py}}
      name: ferry times
bundle: {name: bundle}
'''
INSECURE = '''
bundle: {name: ticket-office}
resources:
  jobs:
    tickets:
      name: sell
      tasks:
        - task_key: sell
          notebook_task:
            base_parameters: {till: "4", password: "open the till", api_key: "k-900"}
            notebook_path: ./sell.py
'''
BROKEN = "bundle:\n  name: test\n    invalid: indentation"


@pytest.fixture(scope="module")
def configs(spark):
    texts = {"valid": VALID, "invalid": INVALID, "poor": POOR, "insecure": INSECURE, "broken": BROKEN, "empty": ""}
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_structure(configs):
    got = {r.path: r for r in cfg.lint_config(configs, F.lit("prod")).collect()}
    assert got["valid"].passed and got["valid"].errors == [] and got["valid"].advice == []
    assert rules.LINT_NO_NAME in got["invalid"].errors and rules.LINT_NO_TASKS in got["invalid"].errors
    assert got["poor"].passed
    assert {rules.LINT_VAGUE_NAME, rules.LINT_EXISTING_CLUSTER, rules.LINT_NO_EMAIL} <= set(got["poor"].advice)
    assert got["insecure"].errors == [rules.LINT_SECRETS]
    assert got["broken"].errors == [rules.LINT_BAD_YAML] and got["empty"].errors == [rules.LINT_BAD_YAML]


def test_practices(configs):
    got = {r.path: r for r in cfg.lint_practices(configs, F.lit("dev")).collect()}
    assert got["valid"].score == 85
    assert got["poor"].score == 75 and len(got["poor"].suggestions) == 3
    prod = {r.path: r.score for r in cfg.lint_practices(configs, F.lit("prod")).collect()}
    assert prod["poor"] == 80 and prod["valid"] == 90


def test_secrets(spark, configs):
    got = {r.path: r for r in cfg.lint_secrets(configs).collect()}
    assert got["valid"].passed
    assert got["insecure"].issues == [rules.SECRET_PASSWORD, rules.SECRET_API_KEY]
    texts = [("ref", "PASSWORD: ${secrets.a}"), ("far", "password: " + " " * 45 + "${x}"),
             ("first", "password: ${a}" + " " * 60 + "password: open"), ("upper", "Api_Key: 1")]
    passed = {r.path: r.passed for r in cfg.lint_secrets(spark.createDataFrame(texts, "path string, content string")).collect()}
    assert passed == {"ref": True, "far": False, "first": True, "upper": False}


def runs_of(spark, *rows):
    return spark.createDataFrame(
        [(i, f"/b{i}", "dev", *r) for i, r in enumerate(rows)],
        "run_id long, bundle_path string, target string, stdout string, stderr string, return_code long")


def test_run_logs(spark):
    runs = runs_of(spark, ("x", " Error:  one \nWarning: w\nerror: no\nError:two", 1), ("Validation OK!", "Error: late", 1),
                   ("Name: a:b\nName:c\n Host: no\nUser: u", "", 0), ("y" * 1500, "z", 0))
    got = cfg.parse_cli_runs(runs, 1000).orderBy("run_id").collect()
    assert got[0].errors == ["one", "two"] and got[0].warnings == ["w"] and not got[0].validation_passed
    assert got[1].validation_passed and got[1].total_errors == 1
    assert (got[2].bundle_info.name, got[2].bundle_info.host, got[2].bundle_info.user) == ("c", None, "u")
    assert len(got[3].stdout_tail) == 1000 and len(cfg.parse_cli_runs(runs).orderBy("run_id").collect()[3].stdout_tail) == 1500
    assert [r.validation_passed for r in cfg.validation_rows(runs).orderBy("run_id").collect()] == [False, False, True, True]


def test_advice(spark, configs):
    runs = runs_of(spark, ("", "Error: a\nError: b\nError: c\nError: d\nWarning: w", 1), ("", "", 0))
    linted = configs.filter("path = 'insecure'").withColumn("path", F.lit("/b0/databricks.yml")).withColumn("target", F.lit("dev"))
    checked = cfg.validate(runs, linted)
    first, second = cfg.advice(checked, first=3).orderBy("run_id").collect()
    assert first.immediate_actions == [
        "Fix validation errors before deployment", "- a", "- b", "- c", rules.SECRET_PASSWORD, rules.SECRET_API_KEY]
    assert first.improvements[:2] == ["Review warnings for potential issues", "Improve configuration based on best practices"]
    assert "- d" in cfg.advice(checked).orderBy("run_id").first().immediate_actions
    assert second.immediate_actions == [] and second.improvements == []
    assert second.next_steps[0] == "Bundle is ready for deployment"
    tool = cfg.advice(checked, "tool").orderBy("run_id").collect()
    assert len(tool[1].improvements) == 3  # no lint at all counts as score 0
    assert rules.TOOL_ADVICE["security"][0] in tool[1].immediate_actions


def test_render_cluster(spark):
    clusters = spark.createDataFrame(
        [("a", "v1", "n1", None, 0, {}), ("b", "v2", "n2", 3, 20, {"z": "1", "a": "2"})],
        "cluster_id string, spark_version string, node_type_id string, num_workers int, autotermination_minutes int, spark_conf map<string,string>")
    a, b = [r.job_cluster_yaml for r in cfg.render_cluster(clusters).orderBy("cluster_id").collect()]
    assert a.endswith("num_workers: 0") and 'spark_version: "v1"' in a
    assert b.endswith('autotermination_minutes: 20\n      spark_conf:\n        a: "2"\n        z: "1"')


def test_bundles(spark, rows):
    files = spark.createDataFrame(
        [("/n/a.py", "import mlflow"), ("/n/b.py", "x = spark.readStream"), ("/n/c.sql", "select plot")],
        "path string, content string")
    bundles = spark.createDataFrame(
        [("one", "/n/a"), ("one", "/n/gone"), ("two", "/n/b"), ("three", "/n/c"), ("three", "/n/b"), ("lost", "/n/x")],
        "bundle_name string, stem string")
    members = cfg.bundle_files(bundles, files)
    assert members.count() == 6 and members.filter("error IS NOT NULL").count() == 2
    assert dict(rows(cfg.dominant_workflow(members))) == {"one": "ml", "two": "etl", "three": "etl", "lost": "etl"}
    assert dict(rows(cfg.bundle_pattern(members), "bundle_name", "pattern")) == {
        "one": "ml", "two": "streaming", "three": "multi_stage", "lost": "simple"}
    told = {r.bundle_name: r for r in cfg.bundle_context(members).collect()}
    assert (told["one"].n_files, told["one"].n_failed) == (2, 1)
    analyses = {(r.bundle_name, r.stem): json.loads(r.analysis) for r in cfg.bundle_analyses(members).collect()}
    assert analyses["one", "/n/a"]["libraries"] == ["mlflow"]
    assert analyses["lost", "/n/x"] == {"error": "Could not analyze file"}


def test_rendered_bundle_is_valid_yaml(spark):
    yaml = pytest.importorskip("yaml")
    jobs = spark.createDataFrame([(5,)], "job_id long")
    tasks = spark.createDataFrame(
        [(5, "b", ["a"], '{"notebook_task": {"notebook_path": "/n/b"}}'),
         (5, "a", [], '{"notebook_task": {"notebook_path": "/n/a"}}'), (5, "w", [], '{"sql_task": {}}')],
        "job_id long, task_key string, depends_on array<string>, settings string")
    patterns = spark.createDataFrame([("job-5-bundle", "multi_stage")], "bundle_name string, pattern string")
    blocks = cfg.render_bundle(jobs, tasks, patterns).orderBy("section", "sort_key").collect()
    text = "".join(b.text for b in blocks)
    parsed = yaml.safe_load(text)
    assert parsed["bundle"]["name"] == "job-5-bundle" and parsed["targets"]["dev"]["default"]
    job = parsed["resources"]["jobs"]["pipeline"]
    assert [t["task_key"] for t in job["tasks"]] == ["a", "b"]
    assert job["tasks"][1]["depends_on"] == [{"task_key": "a"}]
    assert job["job_clusters"][0]["new_cluster"]["num_workers"] == "4" or job["job_clusters"][0]["new_cluster"]["num_workers"] == 4


def test_cluster_choice(spark):
    frame = spark.createDataFrame(
        [("notebook", "c", False), ("python_wheel", "c", True), (None, None, True), (None, None, False)],
        "k string, p string, s boolean")
    got = [r[0] for r in frame.select(cfg.cluster_choice(F.col("k"), F.col("p"), F.col("s"))).collect()]
    assert got == ["serverless", "job_cluster", "environment", "ask"]
