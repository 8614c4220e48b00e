"""Scoring of answers: qa(question, expected, actual, tools_needed, complexity, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import cut, strip

# fixed value: texts that read as a number
NUMBER = r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+)?\z"
ENDLESS = r"^[+-]?inf(?:inity)?\z"


def number(text: Column) -> Column:
    """The number a stripped lower-case text spells, else NULL. 'nan' equals nothing, so NULL."""
    spelled = F.rlike(text, F.lit(NUMBER)) | F.rlike(text, F.lit(ENDLESS))
    return F.when(spelled, F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def check_answer(expected: Column, actual: Column) -> Column:
    """Equal or contained, ignoring case and outer blanks, or the same number; empty is wrong."""
    want, got = strip(F.lower(expected)), strip(F.lower(actual))
    same_number = F.coalesce(number(want) == number(got), F.lit(False))
    return F.when(actual.isNull() | (actual == ""), F.lit(False)).otherwise(F.contains(got, want) | same_number)


def scored(qa: DataFrame) -> DataFrame:
    return qa.withColumn("correct", check_answer(F.col("expected"), F.col("actual")))


def accuracy(qa: DataFrame, *by: str) -> DataFrame:
    """(total, correct, accuracy, passed), overall or by the given columns."""
    totals = scored(qa).groupBy(*by).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    percent = F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("total")), F.lit(0.0))
    return totals.withColumn("accuracy", percent).withColumn("passed", F.col("accuracy") >= rules.PASS_MARK)


def placeholder_rows(qa: DataFrame) -> DataFrame:
    """Questions whose expected answer was never filled in."""
    return qa.filter(F.contains("expected", F.lit(rules.PLACEHOLDER_MARK)))


def placeholder_preview(qa: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """The first n of them by id, the question cut to `width` characters; all and whole without these."""
    found = placeholder_rows(qa)
    rows = found if n is None else found.orderBy("qa_id").limit(n)
    return rows.select("qa_id", cut(F.col("question"), width).alias("question"))
