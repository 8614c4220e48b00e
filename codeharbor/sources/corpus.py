"""The `files` table, derived from the documents table.

The driver tables hold no source code, so each document becomes one file: a template picked by
its id, filled with the document's own values and its whole text as comment lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeharbor.sources.templates import FILE_TEMPLATES

USERS, PROJECTS = 7, 5


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(value) for value in values]), index.cast("int"))


def notebook_stem(doc_id: Column) -> Column:
    """Workspace path, without extension, of the file made from a document id."""
    return F.concat(
        F.lit("/Workspace/Users/u"), (doc_id % USERS).cast("string"),
        F.lit("/proj"), (doc_id % PROJECTS).cast("string"),
        F.lit("/nb_"), doc_id.cast("string"),
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content, doc_id, lang, source): one row for every document."""
    return corpus_from(load(spark, sf_dir, "documents"))


def corpus_from(docs: DataFrame) -> DataFrame:
    """The same for any frame of documents, also a streaming one."""
    doc = F.col("doc_id")
    which = doc % len(FILE_TEMPLATES)
    prefix = pick([t[1] for t in FILE_TEMPLATES], which)
    content = pick([t[2] for t in FILE_TEMPLATES], which)
    for mark, value in {
        "{doc}": doc.cast("string"),
        "{src}": F.col("source"),
        "{lang}": F.col("lang"),
        "{sib}": (doc - USERS * PROJECTS).cast("string"),
        "{cousproj}": F.pmod(doc - USERS, F.lit(PROJECTS)).cast("string"),
        "{cous}": (doc - USERS).cast("string"),
        "{upuser}": F.expr(f"(doc_id div 2) % {USERS}").cast("string"),
        "{upproj}": F.expr(f"(doc_id div 2) % {PROJECTS}").cast("string"),
        "{up}": F.expr("doc_id div 2").cast("string"),
        "{text}": F.concat(prefix, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), prefix))),
    }.items():
        content = F.replace(content, F.lit(mark), value)
    return docs.select(
        F.concat(notebook_stem(doc), pick([t[0] for t in FILE_TEMPLATES], which)).alias("path"),
        content.alias("content"),
        "doc_id", "lang", "source",
    )
