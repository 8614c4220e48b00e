"""Turns are kept and told by buckets: few state rows however many turns, and each turn as by itself."""

from pyspark.sql import functions as F

from codeharbor.streaming import streams, turns

from test_agents import SCHEMA
from test_live import dated, run_turns, told


def test_state_rows_are_those_of_buckets_not_of_turns(spark, tmp_path):
    path = str(tmp_path)
    rows = [(f"s{i}", None if i % 7 == 0 else i, k, "assistant", "text", None, None, f"{k} ", None) for i in range(3000) for k in (2, 1)]
    frame = dated(spark, rows)
    frame.coalesce(1).write.mode("append").parquet(f"{path}/in")
    query = run_turns(spark, path, frame.schema)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1024 * 4  # table, end, and timer by key and by time
    dated(spark, [("clock", 0, 0, "user", "text", None, None, None, None)], 1_700_020_000).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run_turns(spark, path, frame.schema)
    assert told(spark, path) == sorted(((f"s{i}", None if i % 7 == 0 else i, "timer", 2, [], "1 2 ", None, None) for i in range(3000)), key=repr)


def test_turns_of_one_bucket_close_each_at_its_time(spark, tmp_path):
    path = str(tmp_path)
    frame = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    out = {}
    for step in range(6):  # a turn opens in each step, is spoken to in the next, and ends one later
        at = 1_700_000_000 + step * 700
        rows = []
        for turn in range(max(0, step - 2), step + 1):
            kind = "result" if step - turn == 2 else "assistant"
            rows += [(None if turn == 1 else "s", turn, step * 10 + k, kind, "text", None, None, f"{step}.{k} ", float(step)) for k in (1, 0)]
        dated(spark, rows, at - step * 100).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = streams.table_stream(spark, f"{path}/in", "*.parquet", frame.schema)
        turns.start_stateful(turns.closed_turns(stream, buckets=1), f"{path}/out", f"{path}/cp").awaitTermination()
        got = {r[1]: r for r in told(spark, path)}
        assert out.items() <= got.items() and set(got) == set(range(max(0, step - 2)))  # told once, when the watermark has passed the result
        out = got
    text = {t: "".join(f"{s}.{k} " for s in (t, t + 1) for k in (0, 1)) for t in range(3)}
    assert out == {t: (None if t == 1 else "s", t, "result", 5, [], text[t], None, float(t + 2)) for t in range(3)}
