"""Imports by category and symbols of Python text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.symbols import py_symbols
from codeharbor.functions.text import find_all, tally


def base_module(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def category(module: Column) -> Column:
    return (
        F.when(F.startswith(module, F.lit(".")), "local")
        .when(base_module(module).isin(rules.PLATFORM_MODULES), "databricks")
        .when(base_module(module).isin(rules.STANDARD_MODULES), "standard_library")
        .otherwise("third_party")
    )


def categorize(modules: DataFrame) -> DataFrame:
    """Add `category` to rows with a `module`."""
    return modules.withColumn("category", category(F.col("module")))


def _platform_modules(modules: Column) -> Column:
    return F.filter(modules, lambda m: base_module(m).isin(rules.PLATFORM_MODULES))


def tree_modules(modules: Column) -> Column:
    """Distinct modules of a parsed file; platform modules bring their base module along."""
    return F.array_union(modules, F.transform(_platform_modules(modules), base_module))


def regex_modules(content: Column) -> Column:
    """Modules of a file that does not parse: FROM module, else the first of a comma list.

    Duplicates are kept. A platform module adds its base once, and only when the first module
    with that base is not the base itself.
    """
    line = "(?d)" + rules.IMPORT_LINE  # only a line feed ends a line
    origin, names = find_all(content, line, 1), find_all(content, line, 2)
    modules = F.zip_with(
        origin, names, lambda o, n: F.when(o != "", o).otherwise(F.regexp_extract(n, r"^[^\s,]+", 0))
    )
    firsts = F.aggregate(
        _platform_modules(modules),
        F.array().cast("array<string>"),
        lambda seen, m: F.when(
            F.exists(seen, lambda s: base_module(s) == base_module(m)), seen
        ).otherwise(F.array_append(seen, m)),
    )
    extra = F.transform(F.filter(firsts, lambda m: m != base_module(m)), base_module)
    return F.concat(modules, extra)


def with_symbols(files: DataFrame, units: Column | None = None) -> DataFrame:
    """Add `units`, the code texts to parse, and `symbols`, one struct for each of them.

    Files without Python units send nothing but an empty list to the worker.
    """
    units = F.array("content") if units is None else units
    return files.withColumn("units", units).withColumn("symbols", py_symbols("units"))


def unit_modules(unit: Column, symbols: Column) -> Column:
    """Modules of one unit: distinct when it parses, as found by pattern when not."""
    return F.when(symbols["parsed"], tree_modules(symbols["modules"])).otherwise(regex_modules(unit))


def module_list(units: Column, symbols: Column) -> Column:
    """Modules of all units, in unit order."""
    return F.flatten(F.zip_with(units, symbols, unit_modules))


def imports(files: DataFrame) -> DataFrame:
    """(path, parsed, category, module, n): n is how often the module stands in its list."""
    found = with_symbols(files)
    rows = found.select(
        "path",
        F.get("symbols", 0)["parsed"].alias("parsed"),
        F.inline(tally(module_list(F.col("units"), F.col("symbols")))).alias("module", "n"),
    )
    return categorize(rows).select("path", "parsed", "category", "module", "n")


def definition_list(symbols: Column) -> Column:
    return F.flatten(F.transform(symbols, lambda s: s["definitions"]))


def symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, args, lineno) of every function and class."""
    return with_symbols(files).select("path", F.inline(definition_list(F.col("symbols"))))
