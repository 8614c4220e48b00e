"""SQL text to statements, with quotes and comments respected, by built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import cut, drop_words, find_all, strip

# fixed values: a statement is a body up to ';' plus the blank and comment lines after it.
# Possessive repeats keep matching iterative, so long texts cannot overflow the stack.
DOLLAR = r"\$(\w*)\$.*?\$\1\$"
BODY = rf"""(?:[^;'"`/#$-]++|'[^']*'|"[^"]*"|`[^`]*`|--[^\n]*|\# [^\n]*|/\*.*?\*/|{DOLLAR}|[^;])++"""
CLOSE = r";(?:\s|--[^\n]*|\# [^\n]*)*+"
STATEMENT = rf"(?s){BODY}(?:{CLOSE})?|{CLOSE}"
FIRST_WORD = r"(?s)^(?:\s|--[^\n]*+|\# [^\n]*+|/\*.*?\*/)*+(CREATE\s+OR\s+REPLACE|[A-Za-z]+)"
TYPED_WORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE",
    "CREATE", "CREATE OR REPLACE", "ALTER", "DROP", "TRUNCATE",
]
# fixed values: what opens and closes a block inside CREATE, BEGIN and DECLARE statements; IF, FOR, WHILE,
# LOOP and REPEAT need no count, as their END names them. A bare BEGIN or BEGIN TRANSACTION opens nothing.
QUOTED = rf"""(?s)'[^']*'|"[^"]*"|`[^`]*`|--[^\n]*|\# [^\n]*|/\*.*?\*/|{DOLLAR}"""
BLOCK_OPEN = r"(?i)\bBEGIN\b(?!\s*(?:;|TRAN|WORK))|(?<!\bEND\s)\bCASE\b"
BLOCK_CLOSE = r"(?i)\bEND\b(?!\s+(?:IF|FOR|WHILE|LOOP|REPEAT)\b)"
BLOCK_START = r"(?i)^\s*(?:CREATE|BEGIN|DECLARE)\b"
BLOCK_WORD = r"(?i)\bBEGIN\b"
READ_TYPES = ["SELECT", "DELETE", "UPDATE"]
WRITE_TYPES = ["INSERT", "CREATE", "MERGE"]


def _in_blocks(pieces: Column) -> Column:
    """Pieces that end at semicolons joined where a block is open: a state machine over the pieces.

    It keeps the depth of blocks, whether the statement can hold blocks, whether its declarations still
    wait for their BEGIN, and the numbers of the pieces that end a statement.
    """
    bare = F.transform(pieces, lambda p: F.regexp_replace(p, QUOTED, " "))
    marks = F.transform(bare, lambda b, i: F.struct(
        i.alias("at"), F.rlike(b, F.lit(BLOCK_START)).alias("may"), F.rlike(b, F.lit(BLOCK_WORD)).alias("begin"),
        F.rlike(b, F.lit(r"(?i)\bDECLARE\b")).alias("declare"),
        (F.regexp_count(b, F.lit(BLOCK_OPEN)) - F.regexp_count(b, F.lit(BLOCK_CLOSE))).alias("change")))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("may"), F.lit(False).alias("waits"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, mark: Column) -> Column:
        fresh = (state["depth"] == 0) & ~state["waits"]
        may = F.when(fresh, mark["may"]).otherwise(state["may"])
        depth = F.when(may, F.greatest(F.lit(0), state["depth"] + mark["change"])).otherwise(F.lit(0))
        waits = may & ~mark["begin"] & (state["waits"] | mark["declare"]) & (depth == 0)
        ends = F.when((depth == 0) & ~waits, F.concat(state["ends"], F.array(mark["at"]))).otherwise(state["ends"])
        return F.struct(depth.alias("depth"), may.alias("may"), waits.alias("waits"), ends.alias("ends"))

    ends = F.aggregate(marks, start, step)["ends"]
    ends = F.array_union(ends, F.array(F.size(pieces) - 1))  # an open block ends with the text

    def cut(last: Column) -> Column:
        def statement(end: Column, i: Column) -> Column:
            first = F.when(i == 0, F.lit(0)).otherwise(F.get(last, i - 1) + 1)
            return F.array_join(F.slice(pieces, first + 1, end - first + 1), "")

        return F.transform(last, statement)

    return _with(ends, cut)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), 0)


def statement_list(content: Column) -> Column:
    """Statements in order, without the ones that hold nothing but blanks.

    A block between BEGIN and END and a text between dollar quotes are part of one statement.
    """
    pieces = F.filter(F.regexp_extract_all(content, F.lit(STATEMENT), F.lit(0)), lambda s: strip(s) != "")
    return _with(pieces, lambda p: F.when(F.rlike(content, F.lit(BLOCK_WORD)) & (F.size(p) > 0), _in_blocks(p)).otherwise(p))


def statement_type(statement: Column) -> Column:
    first = F.upper(F.regexp_replace(F.regexp_extract(statement, "(?i)" + FIRST_WORD, 1), r"\s+", " "))
    body = F.upper(F.regexp_extract(statement, r"(?i)\)\s*(SELECT|INSERT|UPDATE|DELETE|MERGE)\b", 1))
    word = F.when(first == "WITH", body).otherwise(first)
    return F.when(word.isin(TYPED_WORDS), word).otherwise("UNKNOWN")


def statement_rows(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(statement_list(F.col("content"))).alias("pos", "statement"))
    return rows.select(
        "path",
        (F.col("pos") + 1).cast("long").alias("stmt_no"),
        statement_type(F.col("statement")).alias("stmt_type"),
        "statement",
    )


def sql_statements(files: DataFrame, width: int | None = None) -> DataFrame:
    """(path, stmt_no, stmt_type, statement_prefix): the statement, or its first `width` characters."""
    return statement_rows(files).select(
        "path", "stmt_no", "stmt_type", cut(F.col("statement"), width).alias("statement_prefix")
    )


def names_after(statement: Column, keywords: str) -> Column:
    return drop_words(find_all(statement, rules.STATEMENT_REF % keywords), rules.SQL_DENY_WORDS)


def _reads(statement: Column, kind: Column) -> Column:
    names = F.array_union(names_after(statement, "FROM"), names_after(statement, "JOIN"))
    return F.when(kind.isin(READ_TYPES), names).otherwise(F.array().cast("array<string>"))


def _writes(statement: Column, kind: Column) -> Column:
    names = F.array_distinct(names_after(statement, "INTO|TABLE"))
    return F.when(kind.isin(WRITE_TYPES), names).otherwise(F.array().cast("array<string>"))


def statement_refs(files: DataFrame) -> DataFrame:
    """(path, stmt_no, direction, table_name) gated by statement type, distinct per statement."""
    statement, kind = F.col("statement"), F.col("stmt_type")
    return statement_rows(files).select(
        "path", "stmt_no",
        F.when(kind.isin(READ_TYPES), "input").otherwise("output").alias("direction"),
        F.explode(F.concat(_reads(statement, kind), _writes(statement, kind))).alias("table_name"),
    )


def sql_sources(content: Column) -> Column:
    """Input tables of SQL text: the statement pass and the whole-text pass, distinct."""
    passes = F.flatten(F.transform(statement_list(content), lambda s: _reads(s, statement_type(s))))
    return F.array_union(passes, find_all(content, rules.SQL_FILE_SOURCE))


def sql_targets(content: Column) -> Column:
    """Output tables of SQL text, the same way."""
    passes = F.flatten(F.transform(statement_list(content), lambda s: _writes(s, statement_type(s))))
    return F.array_union(passes, find_all(content, rules.SQL_FILE_TARGET))


def union_refs(files: DataFrame) -> DataFrame:
    """(path, direction, table_name): both passes together, distinct per file."""
    content = F.col("content")
    reads = files.select("path", F.lit("input").alias("direction"), F.explode(sql_sources(content)).alias("table_name"))
    writes = files.select("path", F.lit("output").alias("direction"), F.explode(sql_targets(content)).alias("table_name"))
    return reads.unionByName(writes)
