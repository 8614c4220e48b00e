"""The derived tables, a second time, as SQL common table expressions for the oracle."""

from __future__ import annotations

from codeharbor.sources.assets import NOTEBOOK_EXPRESSIONS, VIEWS, WORKSPACE_CONFIGS
from codeharbor.sources.corpus import PROJECTS, USERS
from codeharbor.sources.templates import FILE_TEMPLATES


def text(value: str | None) -> str:
    """A SQL string literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join(text(value) for value in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"list_extract({text_list(values)}, CAST({index} AS INT) + 1)"


def replace_all(body: str, marks: dict[str, str]) -> str:
    for mark, value in marks.items():
        body = f"replace({body}, {text(mark)}, {value})"
    return body


def _files() -> str:
    which = f"(doc_id % {len(FILE_TEMPLATES)})"
    prefix = pick([t[1] for t in FILE_TEMPLATES], which)
    body = replace_all("body", {
        "{doc}": "CAST(doc_id AS VARCHAR)",
        "{src}": "source",
        "{lang}": "lang",
        "{sib}": f"CAST(doc_id - {USERS * PROJECTS} AS VARCHAR)",
        "{cousproj}": f"CAST(((doc_id - {USERS}) % {PROJECTS} + {PROJECTS}) % {PROJECTS} AS VARCHAR)",
        "{cous}": f"CAST(doc_id - {USERS} AS VARCHAR)",
        "{upuser}": f"CAST((doc_id // 2) % {USERS} AS VARCHAR)",
        "{upproj}": f"CAST((doc_id // 2) % {PROJECTS} AS VARCHAR)",
        "{up}": "CAST(doc_id // 2 AS VARCHAR)",
        "{text}": "prefix || replace(text, chr(10), chr(10) || prefix)",
    })
    return f"""template_rows AS MATERIALIZED (
  SELECT doc_id, lang, source, text, {which} AS template, {prefix} AS prefix,
         {pick([t[2] for t in FILE_TEMPLATES], which)} AS body,
         {pick([t[0] for t in FILE_TEMPLATES], which)} AS extension
  FROM documents),
files AS MATERIALIZED (
  SELECT '/Workspace/Users/u' || (doc_id % {USERS}) || '/proj' || (doc_id % {PROJECTS}) || '/nb_'
           || doc_id || extension AS path,
         {body} AS content, doc_id, lang, source, template
  FROM template_rows)"""


FILES = _files()


def over_files(sql: str, *ctes: str) -> str:
    """A query that may read `files` and the given further CTEs."""
    return "WITH " + ",\n".join([FILES, *ctes]) + "\n" + sql


def asset_cte(view: str) -> str:
    parts = [
        f"SELECT {', '.join(expressions)} FROM {base}" + (f" WHERE {where}" if where else "")
        for base, expressions, where in VIEWS[view]
    ]
    return f"{view} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


NOTEBOOKS = f"notebooks AS MATERIALIZED (SELECT {', '.join(NOTEBOOK_EXPRESSIONS)} FROM files)"
CUSTOMERS = """customers AS (SELECT c_custkey AS id, c_name AS customer_name, c_mktsegment AS customer_segment,
  r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
WORKSPACE_CONFIG_CTE = "workspace_configs AS (" + " UNION ALL ".join(
    f"SELECT {expression} FROM {base}" for base, expression in WORKSPACE_CONFIGS) + ")"


def over(sql: str, *parts: str) -> str:
    """A query over asset views (by name) and further CTE texts."""
    ctes = [asset_cte(part) if part in VIEWS else part for part in parts]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
