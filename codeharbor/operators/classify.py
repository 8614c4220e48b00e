"""File types, usage flags and workflow classes under the three rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import any_of, with_lower

RULESETS = ("deep", "simple", "sdk")


def suffix(path: Column) -> Column:
    """Lower-case extension of the last path part, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def file_type(path: Column, content: Column, ruleset: str = "deep") -> Column:
    if ruleset == "sdk":
        return (
            F.when(F.endswith(path, F.lit(".sql")), "sql")
            .when(F.endswith(path, F.lit(".py")), "python")
            .otherwise("notebook")
        )
    if ruleset == "simple":
        return (
            F.when(F.endswith(path, F.lit(".sql")), "sql")
            .when(F.endswith(path, F.lit(".py")) | F.contains(F.lower(content), F.lit("python")), "python")
            .otherwise("notebook")
        )
    is_notebook = any_of(content, rules.NOTEBOOK_MARKERS)
    return (
        F.when(is_notebook & any_of(content, rules.PYTHON_CELL_MARKERS), "python_notebook")
        .when(is_notebook & any_of(content, rules.SQL_CELL_MARKERS), "sql_notebook")
        .when(is_notebook, "mixed_notebook")
        .when(suffix(path) == ".py", "python")
        .when(suffix(path) == ".sql", "sql")
        .when(suffix(path) == ".ipynb", "jupyter_notebook")
        .when(any_of(content, rules.PYTHON_CLUES), "python")
        .when(any_of(F.lower(content), rules.SQL_CLUES), "sql")
        .otherwise("unknown")
    )


def with_file_type(files: DataFrame, ruleset: str = "deep") -> DataFrame:
    return files.withColumn("file_type", file_type(F.col("path"), F.col("content"), ruleset))


def usage_flags(files: DataFrame) -> DataFrame:
    lower = F.lower("content")
    return files.select(
        "path",
        F.contains(lower, F.lit("spark")).alias("uses_spark"),
        F.contains(lower, F.lit("mlflow")).alias("uses_mlflow"),
        any_of(F.col("content"), ["@dlt.", "import dlt"]).alias("uses_dlt"),
    )


def _stages(lower: Column, stages: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(lower, words), name) for name, words in stages.items()]))


def with_workflow(files: DataFrame) -> DataFrame:
    """Add workflow_type, stages and confidence of the deep rule set.

    Three projections: lower-cased text, stage hits, verdict. Each hit list is computed once
    because Spark keeps a column that later columns use several times.
    """
    hits = with_lower(files).withColumns(
        {
            "_report": any_of(F.col("_lower"), rules.REPORT_WORDS),
            "_ml": _stages(F.col("_lower"), rules.ML_STAGES),
            "_etl": _stages(F.col("_lower"), rules.ETL_STAGES),
            "_ddl": any_of(F.col("_lower"), rules.DDL_WORDS),
        }
    )
    if "_lower" not in files.columns:
        hits = hits.drop("_lower")
    trained = F.array_contains("_ml", "training")
    verdict = (
        F.when(F.col("_report"), "reporting")
        .when(trained & (F.size("_ml") >= 2), "ML")
        .when(F.size("_etl") >= 2, "ETL")
        .when(F.col("_ddl"), "DDL")
        .when((F.size("_etl") >= 1) & ~trained, "ETL")
        .otherwise("unknown")
    )
    kind = F.col("workflow_type")
    return (
        hits.withColumn("workflow_type", verdict)
        .withColumns(
            {
                "stages": F.when(kind == "reporting", F.array(F.lit("visualization")))
                .when(kind == "ML", F.col("_ml"))
                .when(kind == "ETL", F.col("_etl"))
                .when(kind == "DDL", F.array(F.lit("schema_definition")))
                .otherwise(F.array().cast("array<string>")),
                "confidence": F.when(kind == "reporting", F.lit(0.9))
                .when(kind == "ML", F.least(F.size("_ml") / 3.0, F.lit(1.0)))
                .when(kind == "ETL", F.least(F.size("_etl") / 3.0, F.lit(1.0)))
                .when(kind == "DDL", F.lit(0.8))
                .otherwise(F.lit(0.0)),
            }
        )
        .drop("_report", "_ml", "_etl", "_ddl")
    )


def quick_workflow(content: Column, ruleset: str) -> Column:
    """The one-word class of the simple and sdk rule sets."""
    lower = F.lower(content)
    verdict = F.when(any_of(lower, ["mlflow", "model"]), "ml").when(
        F.contains(content, F.lit("display(")) | F.contains(lower, F.lit("plot")), "reporting"
    )
    if ruleset == "sdk":
        verdict = verdict.when(any_of(content, ["@dlt.", "import dlt"]), "dlt")
    return verdict.otherwise("etl")


def workflow(files: DataFrame, ruleset: str = "deep") -> DataFrame:
    if ruleset == "deep":
        return with_workflow(files).select("path", "workflow_type", "stages", "confidence")
    return files.select("path", quick_workflow(F.col("content"), ruleset).alias("workflow_type"))
