"""Round trips through sources and sinks, and streams run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeharbor.catalog import files_extract as fx
from codeharbor.catalog.agents import GAPS, ORACLE as AGENT_ORACLE, STAMP, stamped
from codeharbor.catalog.views import over, over_files
from codeharbor.functions import rules
from codeharbor.operators import evaluation as ev
from codeharbor.session import checkpoint_dir
from codeharbor.sources import files as src
from codeharbor.sources import sinks
from codeharbor.sources.assets import VIEWS, asset
from codeharbor.sources.corpus import code_corpus, corpus_from, load
from codeharbor.streaming import streams

QUERIES = {}
ORACLE = {}


def scratch(spark, name):
    """A new folder for one run, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


# ---- sources and sinks ------------------------------------------------------------------------------


def _written_bundles(spark, sf_dir):
    """Config texts of all customers as blocks of one bundle per market segment."""
    out = scratch(spark, "bundles")
    blocks = asset(spark, sf_dir, "configs").join(
        load(spark, sf_dir, "customer").select(
            F.concat(F.lit("/bundles/c"), F.col("c_custkey"), F.lit("/databricks.yml")).alias("path"),
            F.lower("c_mktsegment").alias("bundle_name")), "path"
    ).select("bundle_name", F.lit(1).cast("long").alias("section"), F.col("path").alias("sort_key"),
             F.col("content").alias("text"))
    readme = sinks.readme_blocks(blocks.select("bundle_name").distinct())
    blocks = blocks.withColumn("file", F.lit(rules.CONFIG_FILE)).unionByName(readme)
    sinks.write_bundles(blocks, out)
    try:
        sinks.write_bundles(blocks, out)
    except AnalysisException:  # the guard: what is there stays unless overwriting is asked for
        return out
    raise AssertionError("an existing target was overwritten")


def _bundle_lines(spark, sf_dir):
    rows = spark.read.option("basePath", out := _written_bundles(spark, sf_dir)).text(out)
    return rows.groupBy("bundle_name", "file").agg(F.count("*").alias("n_lines"))


def _read_back(spark, sf_dir):
    rows = src.read_files(spark, _written_bundles(spark, sf_dir), "*.txt").filter("path NOT LIKE '%README%'")
    return rows.groupBy(F.regexp_extract("path", "bundle_name=([^/]*)", 1).alias("bundle_name")).agg(
        F.sum(F.char_length("content")).alias("n_chars"), F.sum("n_bytes").alias("n_bytes"))


SEGMENTS = """(SELECT lower(c_mktsegment) AS bundle_name, content FROM configs
  JOIN customer ON path = '/bundles/c' || c_custkey || '/databricks.yml')"""
QUERIES["s7_s8_write_bundles"] = _bundle_lines
ORACLE["s7_s8_write_bundles"] = over(f"""SELECT bundle_name, 'databricks.yml' AS file,
    CAST(sum(len(string_split(regexp_replace(content, '\\n$', ''), chr(10)))) AS BIGINT) AS n_lines
  FROM {SEGMENTS} GROUP BY ALL
  UNION ALL SELECT DISTINCT bundle_name, 'README.md', 6 FROM {SEGMENTS}""", "configs")
QUERIES["s1_read_files"] = _read_back
ORACLE["s1_read_files"] = over(f"""SELECT bundle_name, CAST(sum(len(content)) AS BIGINT) AS n_chars,
    CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM {SEGMENTS} GROUP BY ALL""", "configs")


def _read_sources(spark, sf_dir):
    files = code_corpus(spark, sf_dir).select("path", "content", "doc_id")
    wanted = files.select("path").unionByName(
        files.select(F.concat("path", F.lit(".gone")).alias("path")))
    local = files.filter("path LIKE '%.py'")
    exports = files.filter("path NOT LIKE '%.py'").select("path", F.base64(F.encode("content", "UTF-8")).alias("content"))
    return src.read_sources(wanted, local, exports).select(
        "path", F.char_length("content").cast("long").alias("n_chars"), "error")


QUERIES["s1_s2_read_sources"] = _read_sources
ORACLE["s1_s2_read_sources"] = over_files("""SELECT path, nullif(len(content), 0) AS n_chars,
    CASE WHEN content = '' THEN 'File not found: ' || path END AS error FROM files
  UNION ALL SELECT path || '.gone', NULL, 'File not found: ' || path || '.gone' FROM files""")


def _run_sql(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("codeharbor_orders")
    return src.run_sql(
        spark, "SELECT o_orderstatus, count(*) AS n FROM codeharbor_orders WHERE o_totalprice > :low GROUP BY 1",
        {"low": 1000.0})


QUERIES["s6_run_sql"] = _run_sql
ORACLE["s6_run_sql"] = """SELECT '{"o_orderstatus":"' || o_orderstatus || '","n":"' || count(*) || '"}' AS row
  FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"""
AT = "2024-05-06T07:08:09.000000"


def _envelopes(style):
    def run(spark, sf_dir):
        rows = asset(spark, sf_dir, "warehouses").select(
            "warehouse_id", "auto_stop_mins", F.when(F.col("state").isNull(), "no state").alias("error"))
        return sinks.to_envelope(rows, style, at=F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    return run


INNER = """'{"warehouse_id":"' || warehouse_id || '","auto_stop_mins":' || auto_stop_mins || '}'"""
QUERIES["s9_envelope_mcp"] = _envelopes("mcp")
ORACLE["s9_envelope_mcp"] = over(f"""SELECT CASE WHEN state IS NULL
    THEN '{{"success":false,"error":"no state","timestamp":"{AT}"}}'
    ELSE '{{"success":true,"data":' || {INNER} || ',"timestamp":"{AT}"}}' END AS response FROM warehouses""", "warehouses")
QUERIES["s9_envelope_sdk"] = _envelopes("sdk")
ORACLE["s9_envelope_sdk"] = over(f"""SELECT '{{"content":[{{"type":"text","text":"' || replace(CASE WHEN state IS NULL
    THEN '{{"error":"no state"}}' ELSE {INNER} END, '"', '\\"') || '"}}]}}' AS response FROM warehouses""", "warehouses")


def _qa_xml(spark, sf_dir):
    """Golden questions written as XML, a complexity only for long documents, and read back."""
    out = scratch(spark, "qa")
    asset(spark, sf_dir, "qa").select(
        "question", F.concat(F.lit("  "), F.col("expected"), F.lit(" ")).alias("answer"),
        F.nullif("tools_needed", F.lit("")).alias("tools_needed"),
        F.when(F.col("complexity") == "moderate", F.col("complexity")).alias("complexity"),
    ).write.format("xml").option("rowTag", "qa_pair").option("rootTag", "evaluation").save(out)
    return src.read_qa(spark, out)


QUERIES["s10_read_qa"] = _qa_xml
ORACLE["s10_read_qa"] = over("""SELECT question, trim(expected) AS expected, tools_needed,
    CASE WHEN complexity = 'moderate' THEN complexity ELSE 'unknown' END AS complexity FROM qa""", "qa")


def _results(spark, sf_dir):
    out, qa = scratch(spark, "results"), asset(spark, sf_dir, "qa")
    sinks.write_results(ev.accuracy(qa), ev.scored(qa).select("question", "expected", "correct"), out)
    told = spark.read.schema("question string, expected string, correct boolean").json(f"{out}/questions")
    total = spark.read.schema("total long, correct long").json(f"{out}/summary")
    return told.unionByName(total.selectExpr("'summary' AS question", "cast(total AS string) || ' ' || cast(correct AS string) AS expected", "cast(NULL AS boolean) AS correct"))


QUERIES["s11_write_results"] = _results
ORACLE["s11_write_results"] = over("""SELECT question, expected, correct FROM scored
  UNION ALL SELECT 'summary', count(*) || ' ' || count(*) FILTER (correct), NULL FROM scored""", "qa",
                                   AGENT_ORACLE["c13_check_answer"].split("qa AS MATERIALIZED", 1)[1].split("),\n", 1)[1]
                                   .rsplit("\n", 1)[0])

# ---- streams ------------------------------------------------------------------------------------------


def _refs_stream(spark, sf_dir):
    docs = streams.table_stream(spark, sf_dir, "documents.parquet", load(spark, sf_dir, "documents").schema)
    out, state = scratch(spark, "refs"), scratch(spark, "refs-state")
    streams.append_stream(streams.table_refs_stream(corpus_from(docs)), out, state).awaitTermination()
    return spark.read.parquet(out)


QUERIES["t1_table_refs_stream"] = _refs_stream
ORACLE["t1_table_refs_stream"] = fx.ORACLE["l1_l2_l3_table_refs"]


def _analyze_stream(spark, sf_dir):
    """The whole analysis of each new file, of which the query tells what its oracle can know."""
    docs = streams.table_stream(spark, sf_dir, "documents.parquet", load(spark, sf_dir, "documents").schema)
    out, state = scratch(spark, "analysis"), scratch(spark, "analysis-state")
    streams.append_stream(streams.analyze_stream(corpus_from(docs)), out, state).awaitTermination()
    return spark.read.parquet(out).select("path", "file_type")


QUERIES["t1_analyze_stream"] = _analyze_stream
ORACLE["t1_analyze_stream"] = fx.ORACLE["p4_file_type"]


def _turns_stream(spark, sf_dir):
    """Both parts of the messages, in a stream each, into one table of partial totals."""
    table = scratch(spark, "turns")
    for base in ("conversations", "events"):
        rows = streams.table_stream(spark, sf_dir, f"{base}.parquet", load(spark, sf_dir, base).schema)
        parts = [rows.selectExpr(*expressions) for b, expressions, _ in VIEWS["messages"] if b == base]
        for part in parts:
            streams.turns_stream(part, table, scratch(spark, "turns-state")).awaitTermination()
    return streams.read_turns(spark, table)


QUERIES["t2_turns_stream"] = _turns_stream
ORACLE["t2_turns_stream"] = AGENT_ORACLE["a8_t2_turn_rollup"]


def _calls_stream(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "events.parquet", load(spark, sf_dir, "events").schema)
    base, expressions, where = VIEWS["tool_calls"][0]
    return (rows.filter(where) if where else rows).selectExpr(*expressions).withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(make, *columns):
    """What an append-mode stream tells: windows that the watermark has passed."""
    def run(spark, sf_dir):
        out, state = scratch(spark, "closed"), scratch(spark, "closed-state")
        streams.append_stream(make(_calls_stream(spark, sf_dir)), out, state).awaitTermination()
        return stamped(spark.read.parquet(out), *columns)
    return run


WATERMARK = f"strftime((SELECT max(ts) FROM tool_calls) - INTERVAL 10 MINUTE, {STAMP})"
QUERIES["t3_session_gaps_stream"] = _closed(streams.session_gaps_stream, "session_start", "session_end")
ORACLE["t3_session_gaps_stream"] = over(
    "SELECT * FROM gaps WHERE session_end <= " + WATERMARK, "tool_calls",
    "gaps AS (" + GAPS + ")")
QUERIES["t4_rate_breaches_stream"] = _closed(
    lambda calls: streams.rate_breaches_stream(calls, F.lit(0).cast("long")).drop("limit"), "window_start")
ORACLE["t4_rate_breaches_stream"] = over(f"""SELECT tool_name, strftime(date_trunc('minute', ts), {STAMP}) AS window_start,
    count(*) AS n_calls FROM tool_calls GROUP BY tool_name, date_trunc('minute', ts)
  HAVING strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, {STAMP}) <= {WATERMARK}""", "tool_calls")


def _latest_stream(spark, sf_dir):
    events = streams.table_stream(spark, sf_dir, "events.parquet", load(spark, sf_dir, "events").schema)
    versions = events.selectExpr(
        "'/u' || user_id || '/' || event_type AS path", "event_id AS version", "md5(props) AS digest")
    table, state = scratch(spark, "latest"), scratch(spark, "latest-state")
    streams.upsert_stream(versions, table, ["path"], ["version"], state).awaitTermination()
    return sinks.read_table(spark, table)


QUERIES["t5_upsert_stream"] = _latest_stream
ORACLE["t5_upsert_stream"] = """SELECT '/u' || user_id || '/' || event_type AS path, max(event_id) AS version,
  md5(arg_max(props, event_id)) AS digest FROM events GROUP BY user_id, event_type"""
