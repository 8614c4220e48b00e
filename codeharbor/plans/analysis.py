"""The one-pass file analysis and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import with_lower
from codeharbor.operators import classify, extraction, statements
from codeharbor.operators import imports as imp
from codeharbor.operators.cells import cell_structs
from codeharbor.operators.classify import file_type

PYTHON_TYPES = ["python", "python_notebook"]
SQL_TYPES = ["sql", "sql_notebook"]
INCLUDES = ("dependencies", "data_sources", "patterns")


def _none() -> Column:
    return F.array().cast("array<string>")


def file_info(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        file_type(F.col("path"), F.col("content")).alias("file_type"),
        F.char_length("content").cast("long").alias("size_chars"),
        F.current_timestamp().alias("last_analyzed"),
    )


def _by_type(python: Column, sql: Column | None, per_cell) -> Column:
    """A list that depends on how the file type is analysed."""
    kind = F.col("file_type")
    merged = F.flatten(F.transform("cells", per_cell))
    chosen = F.when(kind.isin(PYTHON_TYPES), python).when(kind == "mixed_notebook", merged)
    if sql is not None:
        chosen = chosen.when(kind.isin(SQL_TYPES), sql)
    return F.coalesce(chosen, _none())


def _cell_list(python, sql=None):
    def pick(cell: Column) -> Column:
        chosen = F.when(cell["language"] == "python", python(cell["text"]))
        if sql is not None:
            chosen = chosen.when(cell["language"] == "sql", sql(cell["text"]))
        return chosen.otherwise(_none())

    return pick


def analyze(files: DataFrame, include: tuple[str, ...] = INCLUDES, feature_limit: int | None = None) -> DataFrame:
    """One wide row per file: type, workflow, dependencies, sources, features, parameters, calls.

    Everything is computed inside the row, so nothing shuffles and the text is read once; columns
    left out of `include` are not computed. Later selects prune what they do not use. Of each feature
    all matches are told, or the first `feature_limit`.
    """
    content, lower = F.col("content"), F.col("_lower")
    typed = with_lower(files)
    if "patterns" in include:
        typed = classify.with_workflow(typed)
    typed = typed.withColumn("file_type", file_type(F.col("path"), content)).withColumn(
        "cells", F.when(F.col("file_type") == "mixed_notebook", cell_structs(content))
    )
    keep = ["path", "file_type", F.char_length("content").cast("long").alias("size_chars")]
    if "patterns" in include:
        keep += ["workflow_type", "stages", "confidence"]
    if "dependencies" in include:
        python_cells = F.transform(F.filter("cells", lambda c: c["language"] == "python"), lambda c: c["text"])
        units = (
            F.when(F.col("file_type").isin(PYTHON_TYPES), F.array("content"))
            .when(F.col("file_type") == "mixed_notebook", python_cells)
            .otherwise(_none())
        )
        typed = imp.with_symbols(typed, units)
        keep += [
            imp.module_list(F.col("units"), F.col("symbols")).alias("modules"),
            imp.definition_list(F.col("symbols")).alias("definitions"),
        ]
    if "data_sources" in include:
        keep += [
            _by_type(
                extraction.input_tables(content), statements.sql_sources(content),
                _cell_list(extraction.input_tables, statements.sql_sources),
            ).alias("input_tables"),
            _by_type(
                extraction.output_tables(content, lower), statements.sql_targets(content),
                _cell_list(extraction.output_tables, statements.sql_targets),
            ).alias("output_tables"),
            _by_type(
                extraction.storage_paths(content), None, _cell_list(extraction.storage_paths)
            ).alias("file_paths"),
            _by_type(
                extraction.delta_handles(content), None, _cell_list(extraction.delta_handles)
            ).alias("delta_tables"),
        ]
    widgets = F.size(extraction.feature_values(content, lower, "widgets")) > 0
    no_params = F.array().cast(extraction.PARAMS_TYPE)
    keep += [
        extraction.feature_array(content, lower, feature_limit).alias("features"),
        F.when(widgets, extraction.widget_params(content)).otherwise(no_params).alias("params"),
        extraction.notebook_callees(content).alias("notebook_dependencies"),
    ]
    return typed.select(*keep)


def recommendation_columns(workflow_type: Column) -> dict[str, Column]:
    """Job settings by workflow, from the fixed recommendation table."""
    names = ["job_type", "schedule", "spark_version", "node_type_id", "num_workers"]
    columns = {}
    for position, name in enumerate(names):
        value = F.lit(None).cast("long" if name == "num_workers" else "string")
        if name == "job_type":
            value = F.lit(rules.DEFAULT_JOB_TYPE)
        for kind, row in rules.RECOMMENDATIONS.items():
            if row[position] is not None:
                value = F.when(workflow_type == kind, F.lit(row[position])).otherwise(value)
        columns[name] = value
    return columns


def recommend(analysed: DataFrame) -> DataFrame:
    """recommendations(path, job_type, ..., libraries, parameters, requires_unity_catalog)."""
    third_party = F.filter(
        "modules",
        lambda m: (imp.category(m) == "third_party") & ~m.isin(rules.BUILT_IN_LIBRARIES),
    )
    first = F.when(F.col("workflow_type") == "ML", F.array(F.lit("mlflow"))).otherwise(_none())
    return analysed.select(
        "path",
        *[c.alias(n) for n, c in recommendation_columns(F.col("workflow_type")).items()],
        F.concat(first, third_party).alias("libraries"),
        F.col("params").alias("parameters"),
        (F.size("input_tables") + F.size("output_tables") > 0).alias("requires_unity_catalog"),
    )


def summary(analysed: DataFrame) -> DataFrame:
    """One short row per file: flags and totals."""
    rec = recommendation_columns(F.col("workflow_type"))
    told = F.concat(
        F.flatten(F.transform("features", lambda f: F.array_append(f["value"], f["feature"]))),
        F.flatten(F.transform("params", lambda p: F.array(p["widget_type"], p["name"], p["default_value"]))),
        F.when(F.size("notebook_dependencies") > 0, F.col("notebook_dependencies")).otherwise(_none()),
    )
    return analysed.select(
        "path",
        "file_type",
        "workflow_type",
        (F.size("input_tables") + F.size("output_tables") > 0).alias("uses_unity_catalog"),
        F.coalesce(F.contains(F.array_join(told, "\n"), F.lit("mlflow")), F.lit(False)).alias("uses_mlflow"),
        (F.size("params") > 0).alias("has_parameters"),
        (F.size("notebook_dependencies") > 0).alias("calls_other_notebooks"),
        rec["job_type"].alias("recommended_job_type"),
        F.coalesce(rec["node_type_id"], F.lit(rules.DEFAULT_NODE_TYPE)).alias("recommended_cluster"),
        F.size("modules").cast("long").alias("total_dependencies"),
        (F.size("input_tables") + F.size("output_tables") + F.size("file_paths") + F.size("delta_tables"))
        .cast("long").alias("total_data_sources"),
    )


def corpus_overview(files: DataFrame) -> DataFrame:
    """Files, distinct tables and references per (workflow, file type).

    One narrow pass over the text; then only (workflow, type, table) rows move. The table counts
    pre-aggregate by (workflow, type, table) before their shuffle, so a table named by a third
    of the files costs one row per map task.
    """
    content = F.col("content")
    analysed = classify.with_workflow(with_lower(files)).select(
        "workflow_type",
        file_type(F.col("path"), content).alias("file_type"),
        F.concat(extraction.input_tables(content), extraction.output_tables(content, F.col("_lower"))).alias("refs"),
    )
    per_table = (
        analysed.select("workflow_type", "file_type", F.posexplode_outer("refs").alias("pos", "table_name"))
        .groupBy("workflow_type", "file_type", "table_name")
        .agg(
            F.count("table_name").alias("n_refs"),
            # position 0 or no position: the file's first row, so files are counted once
            F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("n_files"),
        )
    )
    return per_table.groupBy("workflow_type", "file_type").agg(
        F.sum("n_files").alias("n_files"),
        F.count("table_name").alias("n_tables"),
        F.sum("n_refs").alias("n_refs"),
    )
