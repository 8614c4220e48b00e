"""Notebook cells, built inside the row: no explode of lines, no window, no shuffle of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import any_of, let, tally, unix_lines
from codeharbor.operators import extraction, statements
from codeharbor.operators import imports as imp

# fixed values: a line that names a magic; a line that starts a magic command
MAGIC_WORD = r"(?md)^# MAGIC %([A-Za-z0-9_]+)"
MAGIC_LINE = r"^\s*# MAGIC %"
MAGIC_START = rules.MAGIC_PREFIX + "%"


def cell_structs(content: Column) -> Column:
    """array of struct(text, language, n_lines, line_start), empty cells dropped.

    Every step is linear in the length of the file, whatever the number of its cells.
    """
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(unix_lines(content), "\n"))
    return let(lines, lambda known: let(_cut(known), _with_language))


def _cut(lines: Column) -> Column:
    """Cells between separator lines: array of struct(own lines, word, line_start).

    line_start is the line a separator closes minus the cell's length, or for the last cell the
    total of lines minus its length.
    """

    def between(cuts: Column) -> Column:
        ends = F.concat(cuts, F.array(F.size(lines)))
        spans = F.transform(
            ends,
            lambda end, k: F.struct(F.coalesce(F.get(cuts, k - 1) + 1, F.lit(0)).alias("begin"), end.alias("end")),
        )
        return F.transform(F.filter(spans, lambda span: span["end"] > span["begin"]), cell)

    def cell(span: Column) -> Column:
        first_line = span["begin"] + F.when(span["end"] == F.size(lines), 0).otherwise(1)
        own = F.slice(lines, span["begin"] + 1, span["end"] - span["begin"])
        return F.struct(own.alias("own"), _last_magic(own).alias("word"), first_line.cast("long").alias("line_start"))

    is_cut = F.transform(lines, lambda line, i: F.when(any_of(line, rules.CELL_SEPARATORS), i))
    return let(F.filter(is_cut, lambda i: i.isNotNull()), between)


def _last_magic(lines: Column) -> Column:
    """The language the last magic line names, NULL when there is none."""
    named = F.filter(lines, lambda line: F.startswith(line, F.lit(MAGIC_START)) & F.rlike(line, F.lit(MAGIC_WORD)))
    return F.regexp_extract(F.try_element_at(named, F.lit(-1)), MAGIC_WORD, 1)


def _with_language(cells_: Column) -> Column:
    """Carry the language forward: each naming cell's word holds up to the next naming cell."""
    named = F.filter(
        F.transform(cells_, lambda c, i: F.struct(c["word"].alias("word"), i.alias("at"))),
        lambda n: n["word"].isNotNull(),
    )
    start = F.array(F.struct(F.lit("python").alias("word"), F.lit(0).alias("at")))

    def spread(known: Column) -> Column:
        return F.flatten(
            F.transform(
                known,
                lambda n, k: F.array_repeat(
                    n["word"], F.coalesce(F.get(known, k + 1)["at"], F.size(cells_)) - n["at"]
                ),
            )
        )

    return F.zip_with(
        cells_,
        let(F.concat(start, named), spread),
        lambda c, language: F.struct(
            _unmark(c["own"]).alias("text"),
            language.alias("language"),
            F.size(c["own"]).cast("long").alias("n_lines"),
            c["line_start"].alias("line_start"),
        ),
    )


def _unmark(lines: Column) -> Column:
    """The cell's text, without the magic mark on lines that start a magic command."""
    return F.array_join(
        F.transform(
            lines,
            lambda line: F.when(
                F.contains(line, F.lit(MAGIC_START)) & F.rlike(line, F.lit(MAGIC_LINE)),
                F.replace(line, F.lit(rules.MAGIC_PREFIX), F.lit("")),
            ).otherwise(line),
        ),
        "\n",
    )


def cells(files: DataFrame) -> DataFrame:
    """(path, cell_no, language, line_start, n_lines, content)."""
    return files.select("path", F.posexplode(cell_structs(F.col("content"))).alias("pos", "c")).select(
        "path",
        (F.col("pos") + 1).cast("long").alias("cell_no"),
        F.col("c.language").alias("language"),
        F.col("c.line_start").alias("line_start"),
        F.col("c.n_lines").alias("n_lines"),
        F.col("c.text").alias("content"),
    )


def running_language(files: DataFrame) -> DataFrame:
    """(path, cell_no, language): the language in force at the end of every cell."""
    return cells(files).select("path", "cell_no", "language")


def cell_number(files: DataFrame) -> DataFrame:
    """(path, line_start, cell_no): the running number of every cell at its start line."""
    return cells(files).select("path", "line_start", "cell_no")


def cell_findings(cell: Column, modules: Column) -> Column:
    """array of struct(kind, value) of one cell, by its language."""

    def labelled(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    text, language = cell["text"], cell["language"]
    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    python = F.concat(
        F.transform(modules, lambda m: F.struct(imp.category(m).alias("kind"), m.alias("value"))),
        labelled("input_tables", extraction.input_tables(text)),
        labelled("output_tables", extraction.output_tables(text)),
        labelled("file_paths", extraction.storage_paths(text)),
        labelled("delta_tables", extraction.delta_handles(text)),
    )
    sql = F.concat(
        labelled("input_tables", statements.sql_sources(text)),
        labelled("output_tables", statements.sql_targets(text)),
    )
    return F.when(language == "python", python).when(language == "sql", sql).otherwise(nothing)


def mixed_analysis(files: DataFrame) -> DataFrame:
    """(path, kind, value, n): merged per-cell findings; n counts how often the merged list holds
    the value. Languages are distinct, so their n is 1. All of it happens inside the file's row.
    """
    rows = files.select("path", cell_structs(F.col("content")).alias("cells"))
    code = F.transform("cells", lambda c: F.when(c["language"] == "python", c["text"]).otherwise(""))
    found = imp.with_symbols(rows, code)
    modules = F.zip_with("units", "symbols", imp.unit_modules)
    findings = F.flatten(F.zip_with("cells", modules, cell_findings))
    languages = F.transform(
        F.array_distinct(F.transform("cells", lambda c: c["language"])),
        lambda name: F.struct(F.lit("languages_used").alias("kind"), name.alias("value")),
    )
    counted = found.select("path", F.inline(tally(F.concat(languages, findings))).alias("found", "n"))
    return counted.select("path", "found.kind", "found.value", "n")
