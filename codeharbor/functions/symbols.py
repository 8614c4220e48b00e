"""Python syntax facts of one text, as one Arrow-batched column.

The only extraction that needs Python: imports and definitions are read from the syntax tree.
Only the text of the files crosses to the worker, and only short lists come back.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFINITION_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("args", T.ArrayType(T.StringType())),
        T.StructField("lineno", T.LongType()),
    ]
)
SYMBOLS_TYPE = T.StructType(
    [
        T.StructField("parsed", T.BooleanType()),
        T.StructField("modules", T.ArrayType(T.StringType())),
        T.StructField("definitions", T.ArrayType(DEFINITION_TYPE)),
    ]
)


def describe(text: str | None) -> tuple:
    """(parsed, imported modules, definitions) of one text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            nodes = list(ast.walk(ast.parse(text or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False, [], []
    modules, definitions = set(), []
    for node in nodes:
        match node:
            case ast.Import():
                modules.update(alias.name for alias in node.names)
            case ast.ImportFrom():
                modules.add("." * node.level + (node.module or ""))
            case ast.FunctionDef():
                definitions.append(("function", node.name, [a.arg for a in node.args.args], node.lineno))
            case ast.ClassDef():
                definitions.append(("class", node.name, None, node.lineno))
    return True, sorted(modules), definitions


@F.pandas_udf(T.ArrayType(SYMBOLS_TYPE))
def py_symbols(units: pd.Series) -> pd.Series:
    """Facts of every code unit of a file: the file itself, or its Python cells."""
    return pd.Series([[] if texts is None else [describe(text) for text in texts] for texts in units])


# Marked so that the optimizer never copies the call into a pushed-down filter and parses twice.
py_symbols = py_symbols.asNondeterministic()
