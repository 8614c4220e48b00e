"""Roll-ups of agent message logs: messages(session_id, turn_id, seq, msg_type, block_type,
tool_name, tool_input, text, cost).

`seq` is a whole number, unique within a session. What the reader of a session sees in order is
given as rows with their `seq`, not as lists, so a session of any length is a set of short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeharbor.functions import rules
from codeharbor.functions.text import cut, extract_yaml
from codeharbor.functions.tools import call_label, clean_tool, is_destructive, subagent, tool_groups
from codeharbor.plans.running import joined_texts


def _tool_uses(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("block_type") == "tool_use")


def _assistant_text(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("msg_type") == "assistant") & (F.col("block_type") == "text"))


def destructive_calls(messages: DataFrame, mode: str = "mcp") -> DataFrame:
    """Calls that need a confirmation."""
    return calls(messages).filter(is_destructive(F.col("tool"), mode))


def auto_approved_calls(messages: DataFrame, mode: str = "mcp") -> DataFrame:
    return calls(messages).filter(~is_destructive(F.col("tool"), mode))


def calls(messages: DataFrame) -> DataFrame:
    return _tool_uses(messages).select("session_id", "seq", clean_tool(F.col("tool_name")).alias("tool"))


def calls_by_category(messages: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(tool_group, n_calls): a call counts once in every group its tool is in.

    The groups are the built-in ones, or the rows of registry(tool_group, tool). Calls are counted per
    tool first, so the registry meets as many rows as there are tools.
    """
    if registry is not None:
        counts = calls(messages).groupBy("tool").agg(F.count("*").alias("n"))
        return counts.join(registry.select("tool_group", "tool").distinct(), "tool").groupBy("tool_group").agg(F.sum("n").alias("n_calls"))
    return (
        calls(messages).select(F.explode(tool_groups(F.col("tool"))).alias("tool_group"))
        .groupBy("tool_group").agg(F.count("*").alias("n_calls"))
    )


def tool_names(messages: DataFrame) -> DataFrame:
    """Distinct clean tool names, sorted."""
    return calls(messages).select("tool").distinct().orderBy("tool")


def subagent_calls(messages: DataFrame) -> DataFrame:
    return _tool_uses(messages).filter(F.col("tool_name") == rules.SUBAGENT_TOOL).select(
        "session_id", "seq", subagent(F.col("tool_input")).alias("s")
    ).select("session_id", "seq", "s.*")


def tool_inputs(messages: DataFrame, width: int | None = None) -> DataFrame:
    """(session_id, seq, label, short_input): one display line per call, cut to `width` characters if given."""
    return _tool_uses(messages).select(
        "session_id", "seq",
        call_label(F.col("tool_name"), F.col("tool_input")).alias("label"),
        cut(F.col("tool_input"), width, ellipsis="after").alias("short_input"),
    )


def extracted_configs(messages: DataFrame) -> DataFrame:
    """(session_id, seq, config) of the replies that hold a bundle config."""
    return _assistant_text(messages).select("session_id", "seq", extract_yaml(F.col("text")).alias("config")).filter(
        F.col("config").isNotNull()
    )


def keyword_hits(messages: DataFrame, words: list[str]) -> DataFrame:
    """(session_id, word, rank): words found in replies, each once, by message and then by word
    list. Reduced to at most one row per session and word before anything is ranked."""
    text = F.col("text")
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains(text, F.lit(word)), F.struct(F.lit(place).alias("place"), F.lit(word).alias("word")))
                for place, word in enumerate(words)
            ]
        )
    )
    first = (
        _assistant_text(messages).select("session_id", "seq", F.explode(hits).alias("hit"))
        .groupBy("session_id", F.col("hit.word").alias("word"), F.col("hit.place").alias("place"))
        .agg(F.min("seq").alias("seq"))
    )
    order = Window.partitionBy("session_id").orderBy("seq", "place")
    return first.select("session_id", "word", F.row_number().over(order).cast("long").alias("rank"))


def session_tools(messages: DataFrame) -> DataFrame:
    """(session_id, turn_id, seq, label): the calls of every session, in the order of seq."""
    return _tool_uses(messages).select("session_id", "turn_id", "seq", call_label(F.col("tool_name"), F.col("tool_input")).alias("label"))


def session_summary(messages: DataFrame, width: int | None = None) -> DataFrame:
    """(session_id, n_tools, n_analyzed, validation_summary): totals, all combined per task first."""
    result = F.col("block_type") == "tool_result"
    validated = result & F.endswith("tool_name", F.lit("validate_bundle")) & (F.col("text") != "")
    return messages.groupBy("session_id").agg(
        F.count_if(F.col("block_type") == "tool_use").alias("n_tools"),
        F.count_if(result & F.endswith("tool_name", F.lit("analyze_notebook"))).alias("n_analyzed"),
        F.max_by(F.when(validated, cut(F.col("text"), width)), F.when(validated, F.col("seq"))).alias("validation_summary"),
    )


def session_text(messages: DataFrame) -> DataFrame:
    """(session_id, turn_id, seq, text): the reply texts of every turn, in the order of seq."""
    return _assistant_text(messages).select("session_id", "turn_id", "seq", "text")


def turn_text(messages: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(session_id, turn_id, chunk_no, text): the whole reply of every turn, in chunks of `width` characters.

    The chunks of a turn joined in order are its reply; a turn of any length is spread over tasks.
    """
    replies = session_text(messages)
    return joined_texts(replies, ["session_id", "turn_id"], ["seq"], "text", width)


def turn_partials(messages: DataFrame) -> DataFrame:
    """Totals per turn of a part of the messages, in a form that merges: see `merge_turns`."""
    config = F.when((F.col("msg_type") == "assistant") & (F.col("block_type") == "text"), extract_yaml(F.col("text")))
    cost, said = (F.when(v.isNotNull(), F.struct("seq", v.alias("value"))) for v in (F.col("cost"), config))
    return messages.withColumn("_cost", cost).withColumn("_config", said).groupBy("session_id", "turn_id").agg(
        F.count("*").alias("n_messages"),
        F.count_if(F.col("block_type") == "tool_use").alias("n_tools"),
        F.bool_or(F.col("msg_type") == "result").alias("done"),
        F.max("_cost").alias("cost"), F.max("_config").alias("config"),
    )


def merge_turns(partials: DataFrame) -> DataFrame:
    """One row per turn: counts, last cost, last config, and whether its result message has come."""
    return partials.groupBy("session_id", "turn_id").agg(
        F.sum("n_messages").alias("n_messages"), F.sum("n_tools").alias("n_tools"), F.bool_or("done").alias("done"),
        F.max("cost")["value"].alias("last_cost"), F.max("config")["value"].alias("last_config"),
    )


def turn_rollup(messages: DataFrame) -> DataFrame:
    """The roll-up of a batch; messages may come in any order."""
    return merge_turns(turn_partials(messages))


def message_types(messages: DataFrame) -> DataFrame:
    """(session_id, message_types): the distinct types, at most the handful that exist."""
    return messages.groupBy("session_id").agg(F.array_sort(F.collect_set("msg_type")).alias("message_types"))


# ---- test results --------------------------------------------------------------------------------


def test_rollup(results: DataFrame) -> DataFrame:
    """(suite, tests_passed, tests_failed, total_tests, success) from test_results(suite, test_no,
    success, exception, error). The error texts are `test_errors`."""
    passed = F.col("exception").isNull() & F.coalesce(F.col("success"), F.lit(False))
    return results.groupBy("suite").agg(
        F.count_if(passed).alias("tests_passed"),
        F.count_if(~passed).alias("tests_failed"),
        F.count("*").alias("total_tests"),
        F.bool_and(passed).alias("success"),
    )


def test_errors(results: DataFrame) -> DataFrame:
    """(suite, test_no, error), one row per test that did not pass."""
    text = F.when(
        F.col("exception").isNotNull(),
        F.concat(F.lit("Test "), F.col("test_no"), F.lit(" failed with exception: "), F.col("exception")),
    ).otherwise(
        F.concat(F.lit("Test "), F.col("test_no"), F.lit(" failed: "), F.coalesce(F.col("error"), F.lit("Unknown error")))
    )
    failed = F.col("exception").isNotNull() | ~F.coalesce(F.col("success"), F.lit(False))
    return results.filter(failed).select("suite", "test_no", text.alias("error"))


# ---- time on the call log ---------------------------------------------------------------------------


def session_gaps(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, session_start, session_end, n_calls): runs of calls less than `gap` apart.

    Calls in one bin of length `gap` are one run, so each task first folds its calls into bins; only
    bins are put in order, and a session with very many calls has no more of them than others.
    """
    length = F.expr(f"INTERVAL {gap}")
    bins = calls.groupBy("session_id", F.window("ts", gap).alias("_bin")).agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count("*").alias("_n")
    )
    order = Window.partitionBy("session_id").orderBy("_from")
    fresh = F.coalesce(F.col("_from") >= F.lag("_to").over(order) + length, F.lit(True))
    runs = bins.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order))
    return runs.groupBy("session_id", "_run").agg(
        F.min("_from").alias("session_start"), (F.max("_to") + length).alias("session_end"), F.sum("_n").alias("n_calls")
    ).drop("_run")


def calls_per_window(calls: DataFrame, width: str = "1 minute") -> DataFrame:
    """(tool_name, window_start, n_calls)."""
    return (
        calls.groupBy("tool_name", F.window("ts", width)).agg(F.count("*").alias("n_calls"))
        .select("tool_name", F.col("window.start").alias("window_start"), "n_calls")
    )


def rate_breaches(calls: DataFrame, limit: Column, width: str = "1 minute") -> DataFrame:
    """Windows in which a tool was called more often than its limit."""
    return calls_per_window(calls, width).withColumn("limit", limit).filter(F.col("n_calls") > F.col("limit"))
