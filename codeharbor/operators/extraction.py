"""Text to rows: table references, paths, imports, features, parameters, calls.

Each operator is a narrow projection with arrays that are then exploded, so the file text is
read once, never shuffled, and dropped before rows multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import (
    any_of,
    empty_to_null,
    find_all,
    find_distinct,
    first_n,
    guarded,
    with_lower,
)

# ---- column expressions -----------------------------------------------------------------
# `lower` is the lower-cased text, where a caller has it at hand; it only serves to skip searches.


def table_call_names(content: Column) -> Column:
    return guarded(content, ["spark.table", "spark.read.table"], find_all(content, rules.TABLE_CALL))


def input_tables(content: Column) -> Column:
    """Names read by table calls and by FROM / JOIN anywhere in the text."""
    return F.array_union(table_call_names(content), find_all(content, rules.SQL_SOURCE))


def strict_input_tables(content: Column) -> Column:
    """As `input_tables`, without the import lines that look like FROM clauses."""
    code = F.regexp_replace(content, r"(?md)^\s*from\s+[^\s]+\s+import\b[^\n]*", "")
    return input_tables(code)


def output_tables(content: Column, lower: Column | None = None) -> Column:
    names = find_distinct(content, rules.TABLE_WRITE)
    return names if lower is None else guarded(lower, rules.WRITE_NEEDLES, names)


def storage_paths(content: Column) -> Column:
    return guarded(content, ["/mnt/", "/dbfs/", "/FileStore/"], find_distinct(content, rules.STORAGE_PATH))


def delta_handles(content: Column) -> Column:
    return guarded(content, ["delta.tables.DeltaTable."], find_distinct(content, rules.DELTA_HANDLE, 0))


def sql_inputs(content: Column) -> Column:
    return find_distinct(content, rules.SQL_FILE_SOURCE)


def sql_outputs(content: Column) -> Column:
    return find_distinct(content, rules.SQL_FILE_TARGET)


def notebook_callees(content: Column) -> Column:
    return guarded(content, ["dbutils.notebook.run"], find_all(content, rules.NOTEBOOK_CALL))


# The dotted-name feature, spelled so that a run of letters is tried once, from its first letter:
# a try from inside the run fails the same way, and no shorter run can be followed by the dot.
DOTTED_NAME = r"(?<![a-zA-Z_])([a-zA-Z_]++)\.[a-zA-Z_]++\.[a-zA-Z_]++"
DOTTED_LINE = r"\.[a-zA-Z_]++\.[a-zA-Z_]"


def dotted_names(content: Column) -> Column:
    """First parts of three-part names. A name lies within a line, so only lines with two dots
    around a word are searched; finding those starts at a rare character and is cheap."""
    lines = F.filter(F.split(content, "\n"), lambda line: F.rlike(line, F.lit(DOTTED_LINE)))
    return find_all(F.array_join(lines, "\n"), DOTTED_NAME)


def feature_values(content: Column, lower: Column, feature: str, limit: int | None = None) -> Column:
    """Matches of one feature, the first `limit` if given; each is the array of its groups."""
    pattern, groups = rules.FEATURES[feature]
    flagged = f"(?imd){pattern}"
    if groups < 2:
        matches = dotted_names(content) if feature == "unity_catalog" else find_all(content, flagged, groups)
        found = first_n(matches, limit)
        values = F.transform(found, lambda v: F.array(v))
    else:
        parts = [first_n(find_all(content, flagged, g), limit) for g in range(1, groups + 1)]
        values = F.zip_with(*parts, lambda a, b: F.array(a, b))
    return guarded(lower, rules.FEATURE_NEEDLES[feature], values, "array<array<string>>")


PARAMS_TYPE = "array<struct<widget_type:string,name:string,default_value:string>>"


def widget_params(content: Column) -> Column:
    """Widget definitions as array of struct(widget_type, name, default_value)."""
    kinds, names, defaults = (find_all(content, rules.WIDGET_NEW, g) for g in (1, 2, 3))
    params = F.transform(
        F.arrays_zip(kinds.alias("k"), names.alias("n"), defaults.alias("d")),
        lambda p: F.struct(
            p["k"].alias("widget_type"), p["n"].alias("name"), empty_to_null(p["d"]).alias("default_value")
        ),
    )
    return guarded(content, ["dbutils.widgets."], params, PARAMS_TYPE)


def library_names(content: Column, ruleset: str) -> Column:
    """Distinct known libraries in first-seen order."""
    words = find_distinct(content, rules.IMPORT_WORD)
    if ruleset == "sdk":
        return F.array_intersect(words, F.array(*[F.lit(w) for w in rules.SDK_LIBRARIES]))
    return F.filter(words, lambda word: any_of(word, rules.SIMPLE_LIBRARIES))


def widget_name_list(content: Column, distinct: bool) -> Column:
    names = find_distinct(content, rules.WIDGET_ANY) if distinct else find_all(content, rules.WIDGET_ANY)
    return guarded(content, ["dbutils.widgets."], names)


# ---- operators ------------------------------------------------------------------------------


def _labelled(arrays: dict[str, Column], label: str, value: str) -> Column:
    """One array of struct(label, value) out of several arrays."""

    def tag(name: str, array: Column) -> Column:
        return F.transform(array, lambda v: F.struct(F.lit(name).alias(label), v.alias(value)))

    return F.concat(*[tag(name, array) for name, array in arrays.items()])


def table_refs(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, direction, table_name, n_parts) for Python text, distinct per file and direction."""
    content = F.col("content")
    reads = strict_input_tables(content) if strict else input_tables(content)
    writes = output_tables(content, F.col("_lower"))
    refs = _labelled({"input": reads, "output": writes}, "direction", "table_name")
    return _refs(with_lower(files), refs)


def sql_table_refs(files: DataFrame) -> DataFrame:
    """The same for SQL files: names of one part or more."""
    content = F.col("content")
    refs = _labelled({"input": sql_inputs(content), "output": sql_outputs(content)}, "direction", "table_name")
    return _refs(files, refs)


def _refs(files: DataFrame, refs: Column) -> DataFrame:
    return files.select("path", F.inline(refs)).select(
        "path", "direction", "table_name",
        F.size(F.split("table_name", r"\.")).cast("long").alias("n_parts"),
    )


def path_refs(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(storage_paths(F.col("content"))).alias("file_path"))


def delta_refs(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(delta_handles(F.col("content"))).alias("delta_call"))


def feature_array(content: Column, lower: Column, limit: int | None = None) -> Column:
    """array of struct(feature, ordinal, value ARRAY<STRING>) over all features."""

    def numbered(name: str) -> Column:
        return F.transform(
            feature_values(content, lower, name, limit),
            lambda v, i: F.struct(
                F.lit(name).alias("feature"), (i + 1).cast("long").alias("ordinal"), v.alias("value")
            ),
        )

    return F.concat(*[numbered(name) for name in rules.FEATURES])


def features(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, feature, ordinal, value ARRAY<STRING>), the first `limit` of each feature if given."""
    return with_lower(files).select("path", F.inline(feature_array(F.col("content"), F.col("_lower"), limit)))


def params(files: DataFrame) -> DataFrame:
    """(path, ordinal, widget_type, name, default_value)."""
    return files.select("path", F.posexplode(widget_params(F.col("content"))).alias("pos", "p")).select(
        "path", (F.col("pos") + 1).cast("long").alias("ordinal"), "p.*"
    )


def widget_names(files: DataFrame, distinct: bool = False) -> DataFrame:
    names = widget_name_list(F.col("content"), distinct)
    return files.select("path", F.posexplode(names).alias("pos", "name")).select(
        "path", (F.col("pos") + 1).cast("long").alias("ordinal"), "name"
    )


def libraries(files: DataFrame, ruleset: str = "simple") -> DataFrame:
    names = library_names(F.col("content"), ruleset)
    return files.select("path", F.posexplode(names).alias("pos", "library")).select(
        "path", (F.col("pos") + 1).cast("long").alias("ordinal"), "library"
    )


def notebook_calls(files: DataFrame) -> DataFrame:
    """(path, ordinal, callee), duplicates kept."""
    callees = notebook_callees(F.col("content"))
    return files.select("path", F.posexplode(callees).alias("pos", "callee")).select(
        "path", (F.col("pos") + 1).cast("long").alias("ordinal"), "callee"
    )


def calls_flag(files: DataFrame) -> DataFrame:
    return files.select(
        "path",
        F.contains("content", F.lit("dbutils.notebook.run")).alias("calls_other_notebooks"),
        F.size(notebook_callees(F.col("content"))).cast("long").alias("n_calls"),
    )
