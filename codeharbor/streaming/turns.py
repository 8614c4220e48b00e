"""Agent turns with state: each turn is told once, whole and in order, when it closes.

messages(session_id, turn_id, seq, ts, msg_type, block_type, tool_name, tool_input, text, cost) may come
in any order. What a turn has said stays in keyed state by `seq`, so a message that is delivered again
changes nothing. The result message ends a turn: it closes when the watermark has passed that message,
since nothing before it can come any more. A turn without one closes when it has been idle for long. A
closed turn leaves a mark for as long, so that stragglers do not open it again, and then nothing.

Most turns are a few messages, so a call per turn would cost more than the work: turns are dealt to
buckets by hash, and a bucket's turns are kept, looked through and told together, as Arrow tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codeharbor.functions.text import extract_yaml
from codeharbor.functions.tools import call_label

OUTPUT = (
    "session_id string, turn_id long, closed_by string, n_messages long, tools array<string>, text string, "
    "last_config string, last_cost double"
)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _millis(span: str) -> int:
    """Milliseconds of "<number> <unit>"."""
    found = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", span.strip())
    if not found:
        raise ValueError(f"not a time span: {span}")
    return int(found[1]) * _UNITS[found[2]] * 1000


#: Of one turn: seq and time of its first result message (-1: none yet), time of its last message, and when it closes,
#: or loses its mark if it is closed.
ABOUT = ["turn", "result_seq", "result_ms", "last_ms", "due", "closed"]
PARTS = pa.schema([("turn", pa.string()), ("seq", pa.int64()), ("label", pa.string()), ("said", pa.string()), ("config", pa.string()), ("cost", pa.float64())])
TOLD = "turn string, closed_by string, n_messages long, tools array<string>, text string, last_config string, last_cost double"
NO_TIME = -(2**62)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0 to n - 1 begins among sorted codes, and the end."""
    return np.searchsorted(codes, np.arange(n + 1))


def _last(codes: np.ndarray, values: np.ndarray, n: int) -> list:
    """The last value of each code, None where there is none."""
    out = np.full(n, None, object)
    out[codes] = values  # of several the last stays
    return out.tolist()


class TurnProcessor(StatefulProcessor):
    """State of one bucket of turns: what is known of each turn's end, their parts as tables in the order of
    arrival, and one timer, at the first time that something is due."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "data binary")
        self.about = handle.getValueState("about", "timer long, data binary")

    def _known(self) -> tuple[int | None, pd.DataFrame]:
        if not self.about.exists():
            return None, pd.DataFrame({"turn": pd.Series([], dtype=object), **{c: np.empty(0, np.int64) for c in ABOUT[1:5]}, "closed": np.empty(0, bool)})
        timer, data = self.about.get()
        return timer, _unpacked(data).to_pandas()

    def _keep(self, timer: int | None, known: pd.DataFrame, fired: bool = False) -> None:
        if known.empty:
            self.about.clear()
            return
        due = int(known["due"].min())
        if fired or timer != due:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.about.update((due, _packed(pa.Table.from_pandas(known[ABOUT], preserve_index=False))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, known = self._known()
        closed, open_turns = pd.Index(known["turn"][known["closed"]]), known[~known["closed"]]
        lasts, ends = [open_turns[["turn", "last_ms"]]], [open_turns[open_turns["result_seq"] >= 0][["turn", "result_seq", "result_ms"]]]
        for frame in rows:
            frame = frame[~frame["turn"].isin(closed)]  # told already
            if len(frame):
                self.parts.appendValue((_packed(pa.Table.from_pandas(frame[PARTS.names], schema=PARTS, preserve_index=False)),))
                lasts.append(frame.groupby("turn", sort=False)["ms"].max().rename("last_ms").reset_index())
                results = frame[frame["is_result"] & (frame["seq"] >= 0)][["turn", "seq", "ms"]]
                ends.append(results.set_axis(["turn", "result_seq", "result_ms"], axis=1))
        if len(lasts) > 1:
            turns = pd.concat(lasts).groupby("turn", sort=False)["last_ms"].max().reset_index()
            first = pd.concat(ends).sort_values("result_seq", kind="stable").drop_duplicates("turn").set_index("turn")
            at = first.index.get_indexer(turns["turn"])
            for column in ("result_seq", "result_ms"):
                turns[column] = np.append(first[column].to_numpy(np.int64), -1)[at]
            turns["due"] = np.where(turns["result_seq"] >= 0, turns["result_ms"], turns["last_ms"] + self.idle_ms)
            self._keep(timer, pd.concat([known[known["closed"]], turns.assign(closed=False)[ABOUT]], ignore_index=True))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, known = self._known()
        now = timerValues.getCurrentWatermarkInMs()
        if timer is None or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        due = known["due"] <= now
        ended = known[due & ~known["closed"]].reset_index(drop=True)
        known = known[~(due & known["closed"])]
        told = None
        if len(ended):
            parts = pa.concat_tables(_unpacked(data) for (data,) in self.parts.get())
            code = pd.Index(ended["turn"]).get_indexer(parts["turn"].to_pandas())
            rest = parts.filter(pa.array(code < 0))
            if rest.num_rows:
                self.parts.put([(_packed(rest.combine_chunks()),)])
            else:
                self.parts.clear()
            told = self._told(ended, parts.filter(pa.array(code >= 0)), code[code >= 0])
            closing = known["turn"].isin(ended["turn"]) & ~known["closed"]
            marks = known["due"].where(~closing, known["due"].clip(lower=now) + self.idle_ms)
            known = known.assign(due=marks, closed=known["closed"] | closing)
        self._keep(timer, known, fired=True)
        if told is not None:
            yield told

    def _told(self, ended: pd.DataFrame, parts: pa.Table, code: np.ndarray) -> pd.DataFrame:
        n, seq = len(ended), parts["seq"].to_numpy()
        order = np.lexsort((seq, code))  # stable: of a message delivered again the last is meant
        code, seq = code[order], seq[order]
        last = ended["result_seq"].to_numpy()[code]
        kept = np.append((code[1:] != code[:-1]) | (seq[1:] != seq[:-1]), True) & ((last < 0) | (seq <= last))
        order, code = order[kept], code[kept]

        def known(column: str) -> tuple[np.ndarray, np.ndarray]:
            values = parts[column].to_numpy(zero_copy_only=False)[order]
            there = pd.notna(values)
            return code[there], values[there]

        def joined(column: str, make) -> list:
            codes, values = known(column)
            ends = _runs(codes, n)
            return [make(values[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)]

        return pd.DataFrame({
            "turn": ended["turn"], "closed_by": np.where(ended["result_seq"] >= 0, "result", "timer"),
            "n_messages": np.diff(_runs(code, n)), "tools": joined("label", list), "text": joined("said", "".join),
            "last_config": _last(*known("config"), n), "last_cost": pd.Series(_last(*known("cost"), n), dtype="float64"),
        })

    def close(self) -> None:
        pass


def closed_turns(messages: DataFrame, lateness: str = "10 minutes", idle: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """One row per closed turn of a stream of messages, append mode; texts and labels in the order of seq.

    Messages older than the watermark by `lateness` are dropped by Spark. State per open turn is what
    the turn said, in the state store; a turn is put together when it closes, and of its bucket's turns
    those still open are written anew then. `buckets` stays as it is for the life of a checkpoint. Start
    it with `start_stateful`.
    """
    call, reply = F.col("block_type") == "tool_use", (F.col("msg_type") == "assistant") & (F.col("block_type") == "text")
    turn_id, number = F.col("turn_id").cast("long"), F.lit(NO_TIME).cast("long")
    name = F.concat(F.coalesce(turn_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), "session_id"), F.lit("")))
    rows = messages.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("session_id", turn_id), F.lit(buckets)).alias("bucket"), name.alias("turn"),
        F.coalesce(F.col("seq").cast("long"), number).alias("seq"), "ts", F.coalesce(F.unix_millis("ts"), number).alias("ms"),
        F.coalesce(F.col("msg_type") == "result", F.lit(False)).alias("is_result"),
        F.when(call, call_label(F.col("tool_name"), F.col("tool_input"))).alias("label"),
        F.when(reply, F.col("text")).alias("said"), F.when(reply, extract_yaml(F.col("text"))).alias("config"), F.col("cost").cast("double").alias("cost"),
    )
    told = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TurnProcessor(_millis(idle)), outputStructType=TOLD, outputMode="Append", timeMode="EventTime"
    )
    return told.select(
        F.expr("CASE WHEN length(turn) > instr(turn, ':') THEN substring(turn, instr(turn, ':') + 2) END").alias("session_id"),
        F.expr("nullif(substring(turn, 1, instr(turn, ':') - 1), '')").cast("long").alias("turn_id"),
        *[c for c in told.columns if c != "turn"],
    )


def start_stateful(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, exactly once, until the input now present is used up.

    The state store of keyed state and timers is set for this query alone.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return (
            rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out)
        )
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
