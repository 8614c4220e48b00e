"""Imports, symbols, cells, SQL statements and recommendations over the file corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeharbor.catalog import files_extract as fx
from codeharbor.catalog.views import over_files, text, text_list
from codeharbor.functions import rules
from codeharbor.operators import cells, imports, statements
from codeharbor.operators.classify import file_type
from codeharbor.plans import analysis
from codeharbor.sources.corpus import code_corpus

QUERIES = {}
ORACLE = {}


def on_files(name, sql, fn, *ctes):
    QUERIES[name] = lambda spark, sf_dir: fn(code_corpus(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = over_files(sql, *ctes)


def _only(files, types):
    """The corpus with the text of other file types blanked.

    Blank files give no rows. A filter would be pushed below the projection that makes up the
    corpus text and make it up once per rule.
    """
    kind = file_type(F.col("path"), F.col("content"))
    return files.withColumn("content", F.when(kind.isin(types), F.col("content")).otherwise(F.lit("")))


def python_files(files):
    return _only(files, analysis.PYTHON_TYPES)


def sql_files(files):
    return _only(files, analysis.SQL_TYPES)


# ---- imports: the modules of each template that parses are known; the rest goes by regex ------

# template -> modules; {src} stands for the document's source
KNOWN_MODULES = {
    0: ["os", "logging", "pandas", "pyspark.sql", "pyspark", "delta.tables", "delta", "mlflow", "shared_{src}"],
    3: ["mlflow", "mlflow.sklearn", "numpy", "sklearn.ensemble", "sklearn.metrics"],
    4: ["matplotlib.pyplot", "seaborn"],
    5: ["os", "sys", "json", "datetime", "collections", "numpy", "scipy", "pyspark.sql", "pyspark",
        "databricks.feature_store", "databricks", "lib_{src}.tools", ".utils", "..settings", ".", "math"],
    6: ["pyspark.sql", "pyspark"],
    8: ["delta.tables", "delta"],
    9: [],
    10: ["dlt", "pyspark.sql.functions", "pyspark"],
}
PARSED = "(" + ", ".join(str(t) for t in KNOWN_MODULES) + ")"
KNOWN_ROWS = ", ".join(f"({t}, {text(m)})" for t, ms in KNOWN_MODULES.items() for m in ms)
CATEGORY = f"""CASE WHEN starts_with(module, '.') THEN 'local'
  WHEN list_contains({text_list(rules.PLATFORM_MODULES)}, split_part(module, '.', 1)) THEN 'databricks'
  WHEN list_contains({text_list(rules.STANDARD_MODULES)}, split_part(module, '.', 1)) THEN 'standard_library'
  ELSE 'third_party' END"""
TYPED = f"typed AS MATERIALIZED (SELECT *, {fx.DEEP_TYPE} AS file_type FROM files)"
IS_PLATFORM = f"list_contains({text_list(rules.PLATFORM_MODULES)}, split_part(module, '.', 1))"


def import_ctes(source, prefix=""):
    """CTE <prefix>import_rows over the rows (path, unit, source, template, content) of `source`."""
    known, parsed, matched, fallback, extra, rows = (
        prefix + name for name in ("known", "parsed_imports", "matched", "fallback", "extra", "import_rows"))
    return f"""{known}(template, module) AS (VALUES {KNOWN_ROWS}),
{parsed} AS (
  SELECT f.path, f.unit, true AS parsed, replace(k.module, '{{src}}', f.source) AS module, 1 AS n
  FROM ({source}) f JOIN {known} k USING (template)),
{matched} AS (
  SELECT path, unit, {fx.found(rules.IMPORT_LINE, 1)} AS origins, {fx.found(rules.IMPORT_LINE, 2)} AS names
  FROM ({source}) WHERE template NOT IN {PARSED}),
{fallback} AS (
  SELECT path, unit, pos, coalesce(nullif(list_extract(origins, pos), ''),
           trim(split_part(regexp_replace(list_extract(names, pos), '\\s', ',', 'g'), ',', 1))) AS module
  FROM (SELECT *, unnest(range(1, len(names) + 1)) AS pos FROM {matched})),
{extra} AS (
  SELECT path, unit, base AS module FROM (
    SELECT path, unit, split_part(module, '.', 1) AS base, arg_min(module, pos) AS first_module FROM {fallback}
    WHERE {IS_PLATFORM} GROUP BY ALL)
  WHERE base <> first_module),
{rows} AS MATERIALIZED (
  SELECT path, unit, parsed, {CATEGORY} AS category, module, sum(n)::BIGINT AS n FROM (
    SELECT * FROM {parsed}
    UNION ALL SELECT path, unit, false, module, 1 FROM {fallback}
    UNION ALL SELECT path, unit, false, module, 1 FROM {extra}) GROUP BY ALL)"""


IMPORTS = TYPED + ",\n" + import_ctes(
    "SELECT path, 0 AS unit, source, template, content FROM typed WHERE file_type IN ('python', 'python_notebook')")
on_files("l9_l10_imports", "SELECT path, parsed, category, module, n FROM import_rows",
         lambda f: imports.imports(python_files(f)), IMPORTS)
on_files("l9_imports_parsed", "SELECT path, category, module FROM import_rows WHERE parsed",
         lambda f: imports.imports(python_files(f)).filter("parsed").select("path", "category", "module"), IMPORTS)
on_files("l10_imports_fallback", "SELECT path, category, module, n FROM import_rows WHERE NOT parsed",
         lambda f: imports.imports(python_files(f)).filter("NOT parsed").drop("parsed"), IMPORTS)
on_files("j3_import_categories", """SELECT category, split_part(module, '.', 1) AS base, count(*) AS n_files
  FROM import_rows WHERE category <> 'local' GROUP BY ALL""",
         lambda f: imports.imports(python_files(f)).filter("category <> 'local'")
         .groupBy("category", F.substring_index("module", ".", 1).alias("base")).agg(F.count("*").alias("n_files")),
         IMPORTS)

# template, kind, name, args, line
KNOWN_SYMBOLS = [
    (5, "class", "Loader_{src}", None, 15),
    (5, "function", "open", "self,path,mode", 16),
    (5, "function", "inner", "handle", 17),
    (5, "function", "size_{doc}", "frame", 26),
    (10, "function", "bronze_{src}", "", 6),
    (10, "function", "silver_{src}", "", 11),
]
SYMBOL_ROWS = ", ".join(f"({t}, {text(k)}, {text(n)}, {text(a)}, {line})" for t, k, n, a, line in KNOWN_SYMBOLS)
on_files("l12_symbols", """SELECT path, kind, replace(replace(name, '{src}', source), '{doc}', doc_id::VARCHAR) AS name, args,
         lineno::BIGINT AS lineno FROM files JOIN known_symbols USING (template)""",
         lambda f: imports.symbols(python_files(f)).withColumn("args", F.array_join("args", ",")),
         f"known_symbols(template, kind, name, args, lineno) AS (VALUES {SYMBOL_ROWS})")

# ---- statements -----------------------------------------------------------------------------------

# the oracle's patterns know no back references; the corpus has no dollar quotes
DUCK_BODY = statements.BODY.replace(statements.DOLLAR + "|", "").replace("++", "+").replace(r"\# ", "# ")
DUCK_CLOSE = statements.CLOSE.replace("*+", "*").replace(r"\# ", "# ")
DUCK_STATEMENT = f"(?s){DUCK_BODY}(?:{DUCK_CLOSE})?|{DUCK_CLOSE}"
def statement_ctes(source, prefix=""):
    """CTEs <prefix>stmts and <prefix>gated over the rows (path, unit, content) of `source`."""
    pieces, numbered, worded, stmts, gated = (
        prefix + name for name in ("pieces", "numbered", "worded", "stmts", "gated"))
    return f"""{pieces} AS (
  SELECT path, unit, list_filter(regexp_extract_all(content, {text(DUCK_STATEMENT)}, 0),
           lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS found_values FROM ({source})),
{numbered} AS (SELECT *, unnest(range(1, len(found_values) + 1)) AS stmt_no FROM {pieces}),
{worded} AS (
  SELECT path, unit, stmt_no, list_extract(found_values, stmt_no) AS statement,
    upper(regexp_replace(regexp_extract(list_extract(found_values, stmt_no),
      '(?is)^(?:\\s|--[^\\n]*|# [^\\n]*|/\\*.*?\\*/)*(create\\s+or\\s+replace|[a-z]+)', 1), '\\s+', ' ', 'g')) AS word
  FROM {numbered}),
{stmts} AS MATERIALIZED (
  SELECT path, unit, stmt_no, statement,
    CASE WHEN list_contains({text_list(statements.TYPED_WORDS)}, word) THEN word ELSE 'UNKNOWN' END AS stmt_type
  FROM {worded}),
{gated} AS MATERIALIZED (
  SELECT DISTINCT path, unit, stmt_no, direction, table_name FROM (
    SELECT path, unit, stmt_no, 'input' AS direction,
      unnest({fx.found(rules.STATEMENT_REF % 'FROM|JOIN', 1, 'statement')}) AS table_name
    FROM {stmts} WHERE stmt_type IN ('SELECT', 'DELETE', 'UPDATE')
    UNION ALL SELECT path, unit, stmt_no, 'output',
      unnest({fx.found(rules.STATEMENT_REF % 'INTO|TABLE', 1, 'statement')})
    FROM {stmts} WHERE stmt_type IN ('INSERT', 'CREATE', 'MERGE'))
  WHERE NOT list_contains({text_list(rules.SQL_DENY_WORDS)}, upper(table_name)))"""


STATEMENTS = TYPED + ",\n" + statement_ctes(
    "SELECT path, 0 AS unit, content FROM typed WHERE file_type IN ('sql', 'sql_notebook')")
on_files("l6_sql_statements", """SELECT path, stmt_no, stmt_type, substring(statement, 1, 200) AS statement_prefix
  FROM stmts""", lambda f: statements.sql_statements(sql_files(f), 200), STATEMENTS)
on_files("l5_statement_refs", "SELECT path, stmt_no, direction, table_name FROM gated",
         lambda f: statements.statement_refs(sql_files(f)), STATEMENTS)
on_files("p9_u3_denied_names", f"""SELECT path, stmt_no, count(*) AS n_kept FROM (
    SELECT path, stmt_no, unnest({fx.found(rules.STATEMENT_REF % 'INTO|TABLE', 1, 'statement')}) AS t FROM stmts)
  WHERE NOT list_contains({text_list(rules.SQL_DENY_WORDS)}, upper(t)) GROUP BY ALL""",
         lambda f: statements.statement_rows(sql_files(f)).select(
             "path", "stmt_no",
             F.size(statements.names_after(F.col("statement"), "INTO|TABLE")).cast("long").alias("n_kept"),
         ).filter("n_kept > 0"), STATEMENTS)
on_files("u1_union_refs", """SELECT path, direction, table_name FROM gated
  UNION SELECT path, direction, table_name FROM sql_refs SEMI JOIN stmts USING (path)""",
         lambda f: statements.union_refs(sql_files(f)), STATEMENTS, fx.SQL_REFS)

# ---- cells: the oracle goes line by line with windows ---------------------------------------------

CELLS = """lines AS MATERIALIZED (
  SELECT path, line_no, list_extract(all_lines, line_no) AS line, len(all_lines) AS total,
    contains(list_extract(all_lines, line_no), '# COMMAND ----------')
      OR contains(list_extract(all_lines, line_no), '-- COMMAND ----------') AS is_separator
  FROM (SELECT *, unnest(range(1, len(all_lines) + 1)) AS line_no FROM (
    SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS all_lines FROM files))),
pieced AS (
  SELECT *, sum(is_separator::INT) OVER w AS piece,
    last_value(CASE WHEN NOT is_separator THEN nullif(regexp_extract(line, '^# MAGIC %(\\w+)', 1), '') END IGNORE NULLS)
      OVER w AS word
  FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
piece_cells AS (
  SELECT path, piece, coalesce(arg_max(word, line_no) FILTER (word IS NOT NULL), 'python') AS language,
    count(*) AS n_lines, min(line_no) AS first_line, max(line_no) = any_value(total) AS is_last,
    string_agg(CASE WHEN regexp_matches(line, '^\\s*# MAGIC %') THEN replace(line, '# MAGIC ', '') ELSE line END,
               chr(10) ORDER BY line_no) AS content
  FROM pieced WHERE NOT is_separator GROUP BY path, piece),
cells AS MATERIALIZED (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY piece) AS cell_no, language, n_lines, content,
    first_line - CASE WHEN is_last THEN 1 ELSE 0 END AS line_start FROM piece_cells)"""
on_files("l17_cells", "SELECT path, cell_no, language, line_start, n_lines, content FROM cells", cells.cells, CELLS)
on_files("w1_running_language", "SELECT path, cell_no, language FROM cells", cells.running_language, CELLS)
on_files("w2_cell_number", "SELECT path, line_start, cell_no FROM cells", cells.cell_number, CELLS)
on_files("l18_mixed_languages", "SELECT path, language, count(*) AS n_cells FROM cells GROUP BY ALL",
         lambda f: cells.cells(f).groupBy("path", "language").agg(F.count("*").alias("n_cells")), CELLS)
CELL_FINDINGS = statement_ctes("SELECT path, cell_no AS unit, content FROM cells WHERE language = 'sql'", "cell_") + f""",
cell_tables AS (
  SELECT DISTINCT path, cell_no, kind, value FROM (
    SELECT path, cell_no, 'input_tables' AS kind, unnest({fx.PYTHON_READS}) AS value FROM cells WHERE language = 'python'
    UNION ALL SELECT path, cell_no, 'output_tables', unnest({fx.found(rules.TABLE_WRITE)}) FROM cells WHERE language = 'python'
    UNION ALL SELECT path, cell_no, 'file_paths', unnest({fx.found(rules.STORAGE_PATH)}) FROM cells WHERE language = 'python'
    UNION ALL SELECT path, cell_no, 'delta_tables', unnest({fx.found(rules.DELTA_HANDLE, 0)}) FROM cells WHERE language = 'python'
    UNION ALL SELECT path, cell_no, 'input_tables', unnest({fx.found(rules.SQL_FILE_SOURCE)}) FROM cells WHERE language = 'sql'
    UNION ALL SELECT path, cell_no, 'output_tables', unnest({fx.found(rules.SQL_FILE_TARGET)}) FROM cells WHERE language = 'sql'
    UNION ALL SELECT path, unit, direction || '_tables', table_name FROM cell_gated))"""
on_files("l18_mixed_tables", """SELECT path, kind, value, count(*) AS n FROM cell_tables GROUP BY ALL
  UNION ALL SELECT DISTINCT path, 'languages_used', language, 1 FROM cells""",
         lambda f: cells.mixed_analysis(f).filter(F.col("kind").isin(
             "input_tables", "output_tables", "file_paths", "delta_tables", "languages_used")), CELLS, CELL_FINDINGS)
CELL_IMPORTS = import_ctes("""SELECT c.path, c.cell_no AS unit, f.source, f.template, c.content
  FROM cells c JOIN files f USING (path) WHERE c.language = 'python'""", "cell_")
on_files("l18_mixed_analysis", """SELECT path, kind, value, count(*) AS n FROM cell_tables GROUP BY ALL
  UNION ALL SELECT DISTINCT path, 'languages_used', language, 1 FROM cells
  UNION ALL SELECT path, category, module, sum(n)::BIGINT FROM cell_import_rows GROUP BY ALL""",
         cells.mixed_analysis, CELLS, CELL_FINDINGS, CELL_IMPORTS)

# ---- recommendations and summary ---------------------------------------------------------------------


def case_rule(position, default="NULL"):
    whens = " ".join(
        f"WHEN {text(kind)} THEN {text(row[position]) if isinstance(row[position], str) else row[position]}"
        for kind, row in rules.RECOMMENDATIONS.items() if row[position] is not None
    )
    return f"CASE workflow_type {whens} ELSE {default} END"


ANALYSED = f"""third AS (
  SELECT path, string_agg(module, ',' ORDER BY module) AS names, count(*) AS n FROM import_rows
  WHERE category = 'third_party' GROUP BY path),
all_deps AS (SELECT path, sum(n)::BIGINT AS n FROM import_rows GROUP BY path),
py_sources AS (
  SELECT path, count(*) FILTER (direction = 'input' OR direction = 'output') AS n_tables, count(*) AS n_all FROM (
    SELECT path, direction, table_name FROM refs
    UNION ALL SELECT DISTINCT path, 'file', unnest({fx.found(rules.STORAGE_PATH)}) FROM files
    UNION ALL SELECT DISTINCT path, 'delta', unnest({fx.found(rules.DELTA_HANDLE, 0)}) FROM files) GROUP BY path),
sql_sources AS (
  SELECT path, count(*) AS n_tables, count(*) AS n_all FROM (
    SELECT path, direction, table_name FROM gated UNION SELECT path, direction, table_name FROM sql_refs) GROUP BY path),
sources AS (
  SELECT t.path, t.file_type,
    CASE WHEN file_type IN ('python', 'python_notebook') THEN coalesce(p.n_tables, 0)
         WHEN file_type IN ('sql', 'sql_notebook') THEN coalesce(s.n_tables, 0) ELSE 0 END AS n_tables,
    CASE WHEN file_type IN ('python', 'python_notebook') THEN coalesce(p.n_all, 0)
         WHEN file_type IN ('sql', 'sql_notebook') THEN coalesce(s.n_all, 0) ELSE 0 END AS n_all
  FROM typed t LEFT JOIN py_sources p USING (path) LEFT JOIN sql_sources s USING (path)),
feature_rows AS MATERIALIZED ({fx.FEATURE_SQL}),
param_rows AS MATERIALIZED ({fx.PARAMS_SQL}),
told AS (
  SELECT path, bool_or(contains(words, 'mlflow')) AS uses_mlflow FROM (
    SELECT path, concat_ws(' ', feature, value_1, value_2) AS words FROM feature_rows
    UNION ALL SELECT path, concat_ws(' ', name, default_value) FROM param_rows
    UNION ALL SELECT path, unnest({fx.found(rules.NOTEBOOK_CALL)}) FROM files) GROUP BY path),
param_counts AS (SELECT path, count(*) AS n, string_agg(widget_type || ':' || name || ':' || coalesce(default_value, ''), ','
  ORDER BY ordinal) AS params FROM param_rows GROUP BY path)"""
STATEMENTS_AGAIN = STATEMENTS.split(",\n", 1)[1]  # IMPORTS already defines `typed`
ON_ANALYSED = (IMPORTS, STATEMENTS_AGAIN, fx.PYTHON_REFS, fx.SQL_REFS, fx.WORKFLOW, ANALYSED)
on_files("c11_j4_recommend", f"""SELECT w.path, {case_rule(0, text(rules.DEFAULT_JOB_TYPE))} AS job_type,
    {case_rule(1)} AS schedule, {case_rule(2)} AS spark_version, {case_rule(3)} AS node_type_id,
    CAST({case_rule(4)} AS BIGINT) AS num_workers,
    CASE WHEN workflow_type = 'ML' THEN concat_ws(',', 'mlflow', t.names) ELSE coalesce(t.names, '') END AS libraries,
    coalesce(p.params, '') AS parameters, s.n_tables > 0 AS requires_unity_catalog
  FROM workflows w JOIN sources s USING (path) LEFT JOIN third t USING (path) LEFT JOIN param_counts p USING (path)""",
         lambda f: analysis.recommend(analysis.analyze(f, feature_limit=rules.FEATURE_LIMIT)).withColumns({
             "libraries": F.concat_ws(
                 ",", F.filter("libraries", lambda x: x == "mlflow"),
                 F.array_sort(F.filter("libraries", lambda x: x != "mlflow"))),
             "parameters": F.array_join(F.transform("parameters", lambda p: F.concat_ws(
                 ":", p["widget_type"], p["name"], F.coalesce(p["default_value"], F.lit("")))), ","),
         }), *ON_ANALYSED)
on_files("p10_recommended_libraries", f"""SELECT module AS library, count(*) AS n_files FROM (
    SELECT path, module FROM import_rows, range(n) WHERE category = 'third_party'
      AND NOT list_contains({text_list(rules.BUILT_IN_LIBRARIES)}, module)
    UNION ALL SELECT path, 'mlflow' FROM workflows WHERE workflow_type = 'ML') GROUP BY ALL""",
         lambda f: analysis.recommend(analysis.analyze(f, feature_limit=rules.FEATURE_LIMIT)).select(F.explode("libraries").alias("library"))
         .groupBy("library").agg(F.count("*").alias("n_files")), IMPORTS, fx.WORKFLOW)
on_files("c12_summary", f"""SELECT path, s.file_type, workflow_type, s.n_tables > 0 AS uses_unity_catalog,
    coalesce(told.uses_mlflow, false) AS uses_mlflow, coalesce(p.n, 0) > 0 AS has_parameters,
    len({fx.found(rules.NOTEBOOK_CALL)}) > 0 AS calls_other_notebooks,
    {case_rule(0, text(rules.DEFAULT_JOB_TYPE))} AS recommended_job_type,
    {case_rule(3, text(rules.DEFAULT_NODE_TYPE))} AS recommended_cluster,
    coalesce(d.n, 0) AS total_dependencies, s.n_all AS total_data_sources
  FROM workflows JOIN sources s USING (path) JOIN files USING (path) LEFT JOIN told USING (path)
  LEFT JOIN param_counts p USING (path) LEFT JOIN all_deps d USING (path)""",
         lambda f: analysis.summary(analysis.analyze(f, feature_limit=rules.FEATURE_LIMIT)), *ON_ANALYSED)
on_files("a5_dependency_totals", """SELECT s.file_type, sum(coalesce(d.n, 0))::BIGINT AS total_dependencies,
    sum(s.n_all)::BIGINT AS total_data_sources FROM sources s LEFT JOIN all_deps d USING (path) GROUP BY ALL""",
         lambda f: analysis.summary(analysis.analyze(f, feature_limit=rules.FEATURE_LIMIT)).groupBy("file_type").agg(
             F.sum("total_dependencies").alias("total_dependencies"),
             F.sum("total_data_sources").alias("total_data_sources")), *ON_ANALYSED)
on_files("a3_import_lists", """SELECT path, category, string_agg(DISTINCT module, ',' ORDER BY module) AS modules
  FROM import_rows GROUP BY ALL""",
         lambda f: imports.imports(python_files(f)).groupBy("path", "category").agg(
             F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules")), IMPORTS)
on_files("p11_analyze_without_dependencies", f"""SELECT path, workflow_type, round(confidence, 6) AS confidence,
    s.n_tables, s.n_all FROM workflows JOIN sources s USING (path)""",
         lambda f: analysis.analyze(f, ("data_sources", "patterns")).select(
             "path", "workflow_type", F.round("confidence", 6).alias("confidence"),
             (F.size("input_tables") + F.size("output_tables")).cast("long").alias("n_tables"),
             (F.size("input_tables") + F.size("output_tables") + F.size("file_paths") + F.size("delta_tables"))
             .cast("long").alias("n_all")), *ON_ANALYSED)
