"""Rules on single texts: quirks, cells, statements, file types, paths, text functions."""

import random

import pytest
from pyspark.sql import functions as F

from codeharbor.functions import paths
from codeharbor.functions import text as tx
from codeharbor.operators import cells, classify, extraction, imports, statements
from codeharbor.plans import analysis


def files_of(spark, *texts, extension=".py"):
    return spark.createDataFrame(
        [(f"/f{i}{extension}", t) for i, t in enumerate(texts)], "path string, content string"
    )


def one(frame, column):
    return frame.select(column).first()[0]


# ---- quirks ------------------------------------------------------------------------------------


def test_import_lines_count_as_tables_unless_strict(spark, rows):
    files = files_of(spark, "from pyspark.sql import functions\nx = spark.sql('select 1 from a.b')\n")
    assert rows(extraction.table_refs(files), "table_name") == [("a.b",), ("pyspark.sql",)]
    assert rows(extraction.table_refs(files, strict=True), "table_name") == [("a.b",)]


@pytest.mark.parametrize("text, kind, confidence", [
    ("logging.basicConfig()", "reporting", 0.9),
    ("a constraint to evaluate", "ML", 2 / 3),
    ("benefit of spark.read and select", "ETL", 2 / 3),
    ("spark.read", "ETL", 1 / 3),
    ("training, then spark.read", "unknown", 0.0),
    ("create view v as values (1)", "DDL", 0.8),
    ("nothing", "unknown", 0.0),
])
def test_deep_workflow(spark, text, kind, confidence):
    row = classify.workflow(files_of(spark, text)).first()
    assert row.workflow_type == kind and row.confidence == pytest.approx(confidence)


def test_quick_workflows(spark):
    texts = ["a Model", "DISPLAY( no", "display(x)", "import dlt", "x"]
    files = files_of(spark, *texts)
    assert [r.workflow_type for r in classify.workflow(files, "simple").orderBy("path").collect()] == [
        "ml", "etl", "reporting", "etl", "etl"]
    assert [r.workflow_type for r in classify.workflow(files, "sdk").orderBy("path").collect()] == [
        "ml", "etl", "reporting", "dlt", "etl"]


def test_features_keep_groups_and_the_first_ten(spark):
    text = "DELTA.Merge x\n" + "mlflow.log_param(1)\n" * 12 + "main.raw.t /mnt/a/b\n%sql\nSpark.Conf.Set('k', 1)\n"
    found = {}
    for r in extraction.features(files_of(spark, text), 10).orderBy("ordinal").collect():
        found.setdefault(r.feature, []).append(list(r.value))
    assert found["delta_operations"] == [["DELTA", "Merge"]]
    assert found["mlflow_tracking"] == [["log_param"]] * 10
    assert extraction.features(files_of(spark, text)).filter("feature = 'mlflow_tracking'").count() == 12
    assert found["unity_catalog"] == [["main"], ["Spark"]]
    assert found["dbfs_paths"] == [["/mnt/a/b"]]
    assert found["magic_commands"] == [["sql"]]
    assert found["cluster_config"] == [["Set", "k"]]


def test_dotted_names_agree_with_the_plain_pattern(spark):
    import re

    from codeharbor.functions import rules

    pick = random.Random(5)
    texts = ["".join(pick.choice("ab_1. -") for _ in range(300)) for _ in range(60)]
    pattern = rules.FEATURES["unity_catalog"][0]
    want = {f"/f{i}.py": re.findall(pattern, t, re.M | re.I)[:10] for i, t in enumerate(texts)}
    got = {}
    for r in extraction.features(files_of(spark, *texts)).filter("feature = 'unity_catalog'").orderBy("ordinal").collect():
        got.setdefault(r.path, []).append(r.value[0])
    assert got == {path: values for path, values in want.items() if values}


def test_libraries_keep_first_seen_order_and_substrings(spark):
    files = files_of(spark, "import mytorch_x\nimport pandas\nfrom pandas import a\nimport os")
    assert [r.library for r in extraction.libraries(files).orderBy("ordinal").collect()] == ["mytorch_x", "pandas"]
    assert [r.library for r in extraction.libraries(files, "sdk").collect()] == ["pandas"]


def test_widgets_of_both_kinds(spark):
    text = 'dbutils.widgets.text( "a" )\ndbutils.widgets.combobox("b", "")\ndbutils.widgets.get("a")\ndbutils.widgets.get("a")'
    files = files_of(spark, text)
    assert [(r.name, r.default_value) for r in extraction.params(files).orderBy("ordinal").collect()] == [
        ("a", None), ("b", None)]
    assert [r.name for r in extraction.widget_names(files).orderBy("ordinal").collect()] == ["b", "a", "a"]
    assert sorted(r.name for r in extraction.widget_names(files, distinct=True).collect()) == ["a", "b"]


def test_file_types(spark):
    cases = [
        ("/a/x.PY", "x", "python"), ("/a/x.sql", "x", "sql"), ("/a/x.ipynb", "def ", "jupyter_notebook"),
        ("/a/.py", "nothing", "unknown"), ("/a/x", "Select 1", "sql"), ("/a/x", "from here", "python"),
        ("/a/x.sql", "# MAGIC %sql", "sql_notebook"), ("/a/x.py", "# MAGIC %scala", "mixed_notebook"),
        ("/a/x.sql", "# Databricks notebook source\n# COMMAND", "python_notebook"), ("/a/x.txt", "prose", "unknown"),
    ]
    frame = spark.createDataFrame([(p, t) for p, t, _ in cases], "path string, content string")
    got = [r.file_type for r in classify.with_file_type(frame).collect()]
    assert got == [kind for _, _, kind in cases]
    assert [r.file_type for r in classify.with_file_type(frame, "simple").collect()][:3] == ["notebook", "sql", "notebook"]


# ---- imports ------------------------------------------------------------------------------------


def test_fallback_keeps_duplicates_and_adds_a_base_once(spark, rows):
    broken = "x = (\nimport pyspark.sql\nimport pyspark\nfrom delta import a\nimport delta.tables\nimport os, sys\nfrom . import z\n"
    got = rows(imports.imports(files_of(spark, broken)), "category", "module", "n")
    assert got == sorted([
        ("databricks", "pyspark.sql", 1), ("databricks", "pyspark", 2), ("databricks", "delta", 1),
        ("databricks", "delta.tables", 1), ("standard_library", "os", 1), ("local", ".", 1)], key=repr)


def test_symbols(spark, rows):
    code = "class A:\n    def f(self, x, *y, z=1):\n        def g(): pass\nasync def h(): pass\n"
    got = rows(imports.symbols(files_of(spark, code)), "kind", "name", "lineno")
    assert got == [("class", "A", 1), ("function", "f", 2), ("function", "g", 3)]


def test_a_file_that_cannot_be_parsed_at_all_falls_back(spark):
    deep = "(" * 5000 + "\nimport pandas\n"
    assert [r.module for r in imports.imports(files_of(spark, deep, "x = 1\0\nimport numpy")).orderBy("path").collect()] == [
        "pandas", "numpy"]


# ---- cells --------------------------------------------------------------------------------------


def plain_cells(text):
    """Cells of one text, found separator by separator."""
    lines = text.splitlines()
    cuts = [i for i, line in enumerate(lines) if "# COMMAND ----------" in line or "-- COMMAND ----------" in line]
    language, found = "python", []
    for begin, end in zip([-1, *cuts], [*cuts, len(lines)], strict=True):
        body = lines[begin + 1:end]
        for line in body:
            if line.startswith("# MAGIC %"):
                word = "".join(__import__("itertools").takewhile(lambda c: c.isalnum() or c == "_", line[9:]))
                language = word or language
        if body:
            shown = [x.replace("# MAGIC ", "") if x.strip().startswith("# MAGIC %") else x for x in body]
            found.append((language, begin + 2 if end < len(lines) else begin + 1, len(body), "\n".join(shown)))
    return found


def test_cells_of_random_notebooks(spark):
    pick = random.Random(11)
    pool = ["", "x = 1", "# COMMAND ----------", "  -- COMMAND ---------- y", "# MAGIC %sql", "# MAGIC %md # MAGIC z",
            "  # MAGIC %scala", "# MAGIC %", "# MAGIC plain", "tail "]
    texts = [pick.choice(["\n", "\r\n", "\r"]).join(pick.choices(pool, k=pick.randint(0, 12))) + pick.choice(["", "\n"])
             for _ in range(150)] + ["", "\n", "\n\n", "a\x0bb\u2028c"]
    got = {}
    for r in cells.cells(files_of(spark, *texts)).orderBy("path", "cell_no").collect():
        got.setdefault(r.path, []).append((r.language, r.line_start, r.n_lines, r.content))
    for i, text in enumerate(texts):
        assert got.get(f"/f{i}.py", []) == plain_cells(text), repr(text)


def test_a_notebook_of_very_many_cells(spark):
    text = "\n".join(f"# MAGIC %sql\nx{i}\n# COMMAND ----------" if i % 3 else f"y{i}\n# COMMAND ----------" for i in range(40_000))
    row = cells.cells(files_of(spark, text)).agg(F.count("*").alias("n"), F.max("line_start").alias("last"),
                                                F.count_if(F.col("language") == "sql").alias("sql")).first()
    assert (row.n, row.sql) == (40_000, 39_999) and row.last == len(text.splitlines()) - 1


def test_mixed_analysis_merges_cells(spark, rows):
    text = ("import os\nspark.table('a.b')\n# COMMAND ----------\n# MAGIC %sql\nselect 1 from a.b;\ncreate table if not exists c.d (x int)\n"
            "# COMMAND ----------\n# MAGIC %python\nimport os\nspark.table('a.b')\n")
    got = rows(cells.mixed_analysis(files_of(spark, text)), "kind", "value", "n")
    assert ("input_tables", "a.b", 3) in got
    assert ("output_tables", "c.d", 1) in got and ("output_tables", "if", 1) in got
    assert ("standard_library", "os", 2) in got
    assert ("languages_used", "python", 1) in got and ("languages_used", "sql", 1) in got


# ---- statements -----------------------------------------------------------------------------------


def test_statements_respect_quotes_and_comments(spark):
    text = ("-- a; b\nselect 'x;''y' from t1; -- after; this\n/* c; */ insert into t2 select 1;\n"
            "with q as (select 1) delete from t3;create or  replace table t4 as select 1;;  \n# note; x\nvacuum t5")
    rows_ = statements.sql_statements(files_of(spark, text, extension=".sql")).orderBy("stmt_no").collect()
    assert [r.stmt_type for r in rows_] == ["SELECT", "INSERT", "DELETE", "CREATE OR REPLACE", "UNKNOWN", "UNKNOWN"]
    assert rows_[0].statement_prefix.endswith("-- after; this\n")
    assert rows_[1].statement_prefix == "/* c; */ insert into t2 select 1;\n"


def test_very_long_texts_do_not_overflow(spark):
    long_name = "FROM " + ".".join(["a"] * 50_000)
    text = "select 'a;b' -- c;\n, \"q\" ;\n" * 20_000 + long_name
    files = files_of(spark, text, extension=".sql")
    assert statements.sql_statements(files).count() == 20_001
    assert extraction.sql_table_refs(files).count() == 1
    many = "x = (\nimport " + ", ".join(["m"] * 30_000)
    assert [r.module for r in imports.imports(files_of(spark, many)).collect()] == ["m"]


def test_statement_refs_and_union(spark, rows):
    text = "INSERT INTO a.b SELECT * FROM c.d; SELECT * FROM e JOIN f; CREATE TABLE IF NOT EXISTS g (x INT); UPDATE h SET x = 1"
    files = files_of(spark, text, extension=".sql")
    assert rows(statements.statement_refs(files), "direction", "table_name") == [
        ("input", "e"), ("input", "f"), ("output", "a.b"), ("output", "g")]
    assert rows(statements.union_refs(files), "direction", "table_name") == [
        ("input", "c.d"), ("input", "e"), ("input", "f"), ("output", "IF"), ("output", "a.b"), ("output", "g")]


# ---- small functions --------------------------------------------------------------------------------


def apply(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(fn(F.col("v"))).collect()]


def test_source_routing_and_names(spark):
    typed = ["123", "/Workspace/a", "/Repos/b", "/abs", "./x", "../y", "-5", "name", "", " 7 ", "1_000", "1__0"]
    assert apply(spark, typed, paths.source_type) == [
        "job", "workspace", "workspace", "local", "local", "local", "job", "workspace", "workspace", "job", "job", "workspace"]
    assert apply(spark, ["+5", " 12 ", "1_000", "x", "1.5", ""], paths.job_id) == [5, 12, 1000, None, None, None]
    named = ["/a/My_Load  Job.py", "/a/__x--Y__/", "/a/b.tar.gz", "", "...", "/a/.hidden"]
    assert apply(spark, named, lambda c: paths.bundle_name(c, F.lit("local"))) == [
        "my-load-job", "x-y", "btar", "bundle", "bundle", "hidden"]
    assert apply(spark, ["9"], lambda c: paths.bundle_name(c, F.lit("job"))) == ["job-9-bundle"]


def test_path_resolution(spark):
    calls = ["./x", "../y/z", "w", "/abs/./p/../q", "../../../../r"]
    assert apply(spark, calls, lambda c: paths.resolve(F.lit("/u/a/b/nb.py"), c)) == [
        "/u/a/b/x", "/u/a/y/z", "/u/a/b/w", "/abs/q", "/r"]


def test_tally(spark):
    from collections import Counter

    pick = random.Random(2)
    lists = [[pick.choice("abcde") for _ in range(pick.randint(0, 30))] for _ in range(50)]
    got = apply(spark, lists, tx.tally, "array<string>")
    assert [{r.value: r.n for r in row} for row in got] == [dict(Counter(values)) for values in lists]
    pairs = [[("x", "1"), ("x", "2"), ("x", "1")]]
    got = apply(spark, pairs, tx.tally, "array<struct<k:string,v:string>>")[0]
    assert [(tuple(r.value), r.n) for r in got] == [(("x", "1"), 2), (("x", "2"), 1)]


def test_null_and_empty_texts_give_no_rows(spark):
    files = spark.createDataFrame([("/a.py", None), ("/b.py", "")], "path string, content string")
    for found in (extraction.table_refs(files), extraction.sql_table_refs(files), extraction.features(files),
                  extraction.params(files), extraction.notebook_calls(files), cells.cells(files),
                  statements.sql_statements(files), imports.imports(files), imports.symbols(files),
                  cells.mixed_analysis(files)):
        assert found.count() == 0
    for row in analysis.summary(analysis.analyze(files)).collect():
        assert (row.total_data_sources, row.total_dependencies, row.uses_unity_catalog) == (0, 0, False)


def test_text_functions(spark):
    assert apply(spark, ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n", "a\x0cb\x85c"], tx.line_count) == [
        len(t.splitlines()) for t in ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n", "a\x0cb\x85c"]]
    assert apply(spark, ["abcdef"], lambda c: tx.cut(c, 5, ellipsis="inside")) == ["ab..."]
    assert apply(spark, ["abcdef"], lambda c: tx.cut(c, 5, ellipsis="after")) == ["abcde..."]
    assert apply(spark, ["abcdef", "ab"], lambda c: tx.cut(c, 3, "tail")) == ["def", "ab"]
    fenced = "x\n```yaml\nbundle:\n  name: a\n```\n```\nresources: 1\n```"
    assert apply(spark, [fenced, "```python\nbundle: 1\n```", "no"], tx.extract_yaml) == ["bundle:\n  name: a", None, None]
    costs = [0.0, 0.00005, 0.00004, 0.00115, 1.0, 12345.67891, None]
    assert apply(spark, costs, tx.cost_text, "double") == [f"${c:.4f}" if c else None for c in costs]
    assert apply(spark, ["a" * 100], tx.to_b64) == [__import__("base64").b64encode(b"a" * 100).decode()]
