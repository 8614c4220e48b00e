"""File type, extraction and classification queries over the file corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeharbor.catalog.views import over_files, text, text_list
from codeharbor.functions import rules
from codeharbor.functions import text as tx
from codeharbor.operators import classify, extraction
from codeharbor.plans import analysis
from codeharbor.sources.corpus import code_corpus

QUERIES = {}
ORACLE = {}


def on_files(name, sql, fn, *ctes):
    QUERIES[name] = lambda spark, sf_dir: fn(code_corpus(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = over_files(sql, *ctes)


def has(column, words):
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


# ---- file types ---------------------------------------------------------------------------

NOTEBOOK = has("content", rules.NOTEBOOK_MARKERS)
DEEP_TYPE = f"""CASE
  WHEN {NOTEBOOK} AND {has('content', rules.PYTHON_CELL_MARKERS)} THEN 'python_notebook'
  WHEN {NOTEBOOK} AND {has('content', rules.SQL_CELL_MARKERS)} THEN 'sql_notebook'
  WHEN {NOTEBOOK} THEN 'mixed_notebook'
  WHEN lower(path) LIKE '%_.py' THEN 'python'
  WHEN lower(path) LIKE '%_.sql' THEN 'sql'
  WHEN lower(path) LIKE '%_.ipynb' THEN 'jupyter_notebook'
  WHEN {has('content', rules.PYTHON_CLUES)} THEN 'python'
  WHEN {has('upper(content)', ['SELECT', 'CREATE TABLE'])} THEN 'sql'
  ELSE 'unknown' END"""
SIMPLE_TYPE = """CASE WHEN path LIKE '%.sql' THEN 'sql'
  WHEN path LIKE '%.py' OR contains(lower(content), 'python') THEN 'python' ELSE 'notebook' END"""
SDK_TYPE = "CASE WHEN path LIKE '%.sql' THEN 'sql' WHEN path LIKE '%.py' THEN 'python' ELSE 'notebook' END"

on_files("p4_file_type", f"SELECT path, {DEEP_TYPE} AS file_type FROM files",
         lambda f: classify.with_file_type(f).select("path", "file_type"))
on_files("p5_file_type_simple", f"SELECT path, {SIMPLE_TYPE} AS file_type FROM files",
         lambda f: classify.with_file_type(f, "simple").select("path", "file_type"))
on_files("p5_file_type_sdk", f"SELECT path, {SDK_TYPE} AS file_type FROM files",
         lambda f: classify.with_file_type(f, "sdk").select("path", "file_type"))
FLAGS = """contains(lower(content), 'spark') AS uses_spark, contains(lower(content), 'mlflow') AS uses_mlflow,
  contains(content, '@dlt.') OR contains(content, 'import dlt') AS uses_dlt"""
on_files("p7_usage_flags", f"SELECT path, {FLAGS} FROM files", classify.usage_flags)

# ---- table references ----------------------------------------------------------------------


def found(pattern, group=1, column="content"):
    return f"regexp_extract_all({column}, {text(pattern.replace('*+', '*'))}, {group})"


def refs_cte(reads, writes, name="refs"):
    return f"""{name} AS MATERIALIZED (
  SELECT DISTINCT path, direction, table_name FROM (
    SELECT path, 'input' AS direction, unnest({reads}) AS table_name FROM files
    UNION ALL SELECT path, 'output', unnest({writes}) FROM files))"""


PYTHON_READS = f"list_concat({found(rules.TABLE_CALL)}, {found(rules.SQL_SOURCE)})"
PYTHON_REFS = refs_cte(PYTHON_READS, found(rules.TABLE_WRITE))
SQL_REFS = refs_cte(found(rules.SQL_FILE_SOURCE), found(rules.SQL_FILE_TARGET), "sql_refs")
PARTS = "len(string_split(table_name, '.')) AS n_parts"

on_files("l1_l2_l3_table_refs", f"SELECT path, direction, table_name, {PARTS} FROM refs",
         extraction.table_refs, PYTHON_REFS)
on_files("l1_table_reads", f"SELECT DISTINCT path, unnest({found(rules.TABLE_CALL)}) AS table_name FROM files",
         lambda f: f.select("path", F.explode(tx.find_distinct(F.col("content"), rules.TABLE_CALL)).alias("table_name")))
on_files("l2_sql_reads", f"SELECT DISTINCT path, unnest({found(rules.SQL_SOURCE)}) AS table_name FROM files",
         lambda f: f.select("path", F.explode(tx.find_distinct(F.col("content"), rules.SQL_SOURCE)).alias("table_name")))
on_files("l3_table_writes", f"SELECT DISTINCT path, unnest({found(rules.TABLE_WRITE)}) AS table_name FROM files",
         lambda f: f.select("path", F.explode(extraction.output_tables(F.col("content"))).alias("table_name")))
STRICT_FILES = r"""code AS MATERIALIZED (
  SELECT path, array_to_string(list_filter(string_split(content, chr(10)),
           lambda line: NOT regexp_matches(line, '^\s*from\s+[^\s]+\s+import\b')), chr(10)) AS content FROM files)"""
on_files("l2_strict_table_refs", f"""SELECT DISTINCT path, direction, table_name, {PARTS} FROM (
  SELECT path, 'input' AS direction, unnest({PYTHON_READS}) AS table_name FROM code
  UNION ALL SELECT path, 'output', unnest({found(rules.TABLE_WRITE)}) FROM files)""",
         lambda f: extraction.table_refs(f, strict=True), STRICT_FILES)
on_files("l4_sql_table_refs", f"SELECT path, direction, table_name, {PARTS} FROM sql_refs",
         extraction.sql_table_refs, SQL_REFS)
on_files("l7_path_refs", f"SELECT DISTINCT path, unnest({found(rules.STORAGE_PATH)}) AS file_path FROM files",
         extraction.path_refs)
on_files("l8_delta_refs", f"SELECT DISTINCT path, unnest({found(rules.DELTA_HANDLE, 0)}) AS delta_call FROM files",
         extraction.delta_refs)

# ---- features, widgets, libraries, calls -----------------------------------------------------


def numbered(expression, alias, table="files", keys="path"):
    """One row per list element with its 1-based position."""
    return (f"SELECT {keys}, ordinal, list_extract(found_values, ordinal) AS {alias} FROM ("
            f"SELECT {keys}, found_values, unnest(range(1, len(found_values) + 1)) AS ordinal FROM ("
            f"SELECT {keys}, {expression} AS found_values FROM {table}))")


def feature_sql(name):
    pattern, groups = rules.FEATURES[name]
    flagged = f"(?im){pattern}"
    first, second = (found(flagged, 0), None) if groups == 0 else (found(flagged, 1), None)
    if groups == 2:
        second = found(flagged, 2)
    picked = f"list_extract({second}, ordinal)" if second else "NULL"
    return (f"SELECT path, {text(name)} AS feature, ordinal, list_extract({first}, ordinal) AS value_1, "
            f"{picked} AS value_2 FROM (SELECT path, content, "
            f"unnest(range(1, least(len({first}), {rules.FEATURE_LIMIT}) + 1)) AS ordinal FROM files)")


FEATURE_SQL = " UNION ALL ".join(feature_sql(name) for name in rules.FEATURES)
on_files("l13_features", FEATURE_SQL,
         lambda f: extraction.features(f, rules.FEATURE_LIMIT).select(
             "path", "feature", "ordinal", F.get("value", 0).alias("value_1"), F.get("value", 1).alias("value_2")))
PARAMS_SQL = f"""SELECT path, ordinal, list_extract(kinds, ordinal) AS widget_type,
    list_extract(names, ordinal) AS name, nullif(list_extract(defaults, ordinal), '') AS default_value
  FROM (SELECT *, unnest(range(1, len(kinds) + 1)) AS ordinal FROM (
    SELECT path, {found(rules.WIDGET_NEW, 1)} AS kinds, {found(rules.WIDGET_NEW, 2)} AS names,
           {found(rules.WIDGET_NEW, 3)} AS defaults FROM files))"""
on_files("l14_params", PARAMS_SQL, extraction.params)
on_files("l15_widget_names", numbered(found(rules.WIDGET_ANY), "name"), extraction.widget_names)
on_files("l15_widget_names_distinct",
         f"SELECT DISTINCT path, unnest({found(rules.WIDGET_ANY)}) AS name FROM files",
         lambda f: extraction.widget_names(f, distinct=True).select("path", "name"))
on_files("l16_notebook_calls", numbered(found(rules.NOTEBOOK_CALL), "callee"), extraction.notebook_calls)
on_files("l16_calls_flag", f"""SELECT path, contains(content, 'dbutils.notebook.run') AS calls_other_notebooks,
  len({found(rules.NOTEBOOK_CALL)}) AS n_calls FROM files""", extraction.calls_flag)

IMPORT_WORDS = numbered(found(rules.IMPORT_WORD), "library")


def first_seen(condition):
    return f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY min(ordinal)) AS ordinal, library
  FROM ({IMPORT_WORDS}) WHERE {condition} GROUP BY path, library"""


SIMPLE_LIBS = first_seen(has("library", rules.SIMPLE_LIBRARIES))
SDK_LIBS = first_seen(f"list_contains({text_list(rules.SDK_LIBRARIES)}, library)")
on_files("l11_libraries_simple", SIMPLE_LIBS, extraction.libraries)
on_files("l11_libraries_sdk", f"SELECT path, library FROM ({SDK_LIBS})",
         lambda f: extraction.libraries(f, "sdk").select("path", "library"))
on_files("u2_known_libs", f"""SELECT path, library, '{len(rules.SDK_LIBRARIES)}' AS known FROM ({SDK_LIBS})""",
         lambda f: f.select("path", F.explode(tx.known_words(
             tx.find_distinct(F.col("content"), rules.IMPORT_WORD), rules.SDK_LIBRARIES)).alias("library"),
             F.lit(str(len(rules.SDK_LIBRARIES))).alias("known")))

# ---- workflow classes --------------------------------------------------------------------------


def stage_list(stages):
    cases = ", ".join(f"CASE WHEN {has('lower(content)', words)} THEN {text(name)} END" for name, words in stages.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


WORKFLOW = f"""staged AS MATERIALIZED (
  SELECT path, {has('lower(content)', rules.REPORT_WORDS)} AS report, {stage_list(rules.ML_STAGES)} AS ml,
         {stage_list(rules.ETL_STAGES)} AS etl, {has('lower(content)', rules.DDL_WORDS)} AS ddl FROM files),
judged AS (
  SELECT *, CASE WHEN report THEN 'reporting'
    WHEN list_contains(ml, 'training') AND len(ml) >= 2 THEN 'ML'
    WHEN len(etl) >= 2 THEN 'ETL' WHEN ddl THEN 'DDL'
    WHEN len(etl) = 1 AND NOT list_contains(ml, 'training') THEN 'ETL' ELSE 'unknown' END AS workflow_type
  FROM staged),
workflows AS MATERIALIZED (
  SELECT path, workflow_type,
    CASE workflow_type WHEN 'reporting' THEN ['visualization'] WHEN 'ML' THEN ml WHEN 'ETL' THEN etl
      WHEN 'DDL' THEN ['schema_definition'] ELSE [] END AS stages,
    CASE workflow_type WHEN 'reporting' THEN 0.9::DOUBLE WHEN 'ML' THEN len(ml) / 3.0::DOUBLE
      WHEN 'ETL' THEN len(etl) / 3.0::DOUBLE WHEN 'DDL' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM judged)"""
on_files("c1_workflow", """SELECT path, workflow_type, array_to_string(stages, ',') AS stages,
  round(confidence, 6) AS confidence FROM workflows""",
         lambda f: classify.workflow(f).select(
             "path", "workflow_type", F.array_join("stages", ",").alias("stages"),
             F.round("confidence", 6).alias("confidence")), WORKFLOW)
QUICK = """WHEN contains(lower(content), 'mlflow') OR contains(lower(content), 'model') THEN 'ml'
  WHEN contains(content, 'display(') OR contains(lower(content), 'plot') THEN 'reporting'"""
SIMPLE_WORKFLOW = f"CASE {QUICK} ELSE 'etl' END"
SDK_WORKFLOW = f"""CASE {QUICK} WHEN contains(content, '@dlt.') OR contains(content, 'import dlt') THEN 'dlt'
  ELSE 'etl' END"""
on_files("c2_workflow_simple", f"SELECT path, {SIMPLE_WORKFLOW} AS workflow_type FROM files",
         lambda f: classify.workflow(f, "simple"))
on_files("c3_workflow_sdk", f"SELECT path, {SDK_WORKFLOW} AS workflow_type FROM files",
         lambda f: classify.workflow(f, "sdk"))
on_files("q9_notebook_workflow", f"""SELECT path, {SIMPLE_WORKFLOW} AS simple_type, {SDK_WORKFLOW} AS sdk_type
  FROM files""",
         lambda f: f.select("path", classify.quick_workflow(F.col("content"), "simple").alias("simple_type"),
                            classify.quick_workflow(F.col("content"), "sdk").alias("sdk_type")))

# ---- flagship ------------------------------------------------------------------------------------

on_files("corpus_overview", f"""SELECT w.workflow_type, t.file_type, count(DISTINCT w.path) AS n_files,
    count(DISTINCT r.table_name) AS n_tables, count(r.table_name) AS n_refs
  FROM workflows w JOIN (SELECT path, {DEEP_TYPE} AS file_type FROM files) t USING (path)
  LEFT JOIN refs r USING (path) GROUP BY ALL""",
         analysis.corpus_overview, WORKFLOW, PYTHON_REFS)

# ---- text statistics ---------------------------------------------------------------------------------

on_files("l19_text_stats", """SELECT path, CASE WHEN content = '' THEN 0
    ELSE len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) END AS n_lines,
    len(content) AS n_chars FROM files""",
         lambda f: f.select("path", tx.line_count(F.col("content")).alias("n_lines"),
                            F.char_length("content").cast("long").alias("n_chars")))
on_files("l20_file_info", f"SELECT path, {DEEP_TYPE} AS file_type, len(content) AS size_chars FROM files",
         lambda f: analysis.file_info(f).select("path", "file_type", "size_chars"))
