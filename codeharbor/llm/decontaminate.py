"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every word sequence that occurs inside an item. A document's words stream
through it; at each word the state tells the longest sequence ending there that some item holds.
Where that length reaches the window (or a whole shorter item ends), the words are hit. Items are
split into shards of a bounded size; each is broadcast by itself, so a benchmark of any size takes
one pass over the documents per shard and never more memory than one shard.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import fresh_name, total_bytes, written

WINDOW, SHARD_BYTES = 10, 4 * 1024 * 1024
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters (lower-cased), digits and everything beyond ASCII; null has no words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with what is needed to name the items of a match."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.shortest = window
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.ids.setdefault(w, len(self.ids)) for w in words]))
                self.shortest = min(self.shortest, len(words))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.names: dict[tuple[int, int], set] = {}  # (state, length) of a window: the items that hold it
        for name, codes in coded:
            size = min(window, len(codes))
            for state, seen, _ in self.walk(codes):
                if seen >= size:
                    self.names.setdefault((self._of(state, size), size), set()).update(() if name is None else (name,))
        self.shorter: dict[int, list[int]] = {}
        for state, size in self.names:
            if size < window:
                self.shorter.setdefault(state, []).append(size)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def _of(self, state: int, size: int) -> int:
        """The state of the last `size` words of a match that ends in `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def walk(self, codes):
        """(state, longest match, position) after each code."""
        state, seen, nxt, link, length = 0, 0, self.next, self.link, self.length
        for at, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                seen = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                seen += 1
            yield state, seen, at

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (merged, end exclusive) and the names of the items found."""
        get = self.ids.get
        codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        spans, names = [], set()
        for start, end in known.reshape(-1, 2).tolist():
            if end - start < self.shortest:  # words outside the benchmark end every match
                continue
            for state, seen, at in self.walk(codes[start:end].tolist()):
                found = 0
                if seen >= self.window:
                    names |= self.names[self._of(state, self.window), self.window]
                    found = self.window
                if self.shorter:
                    up = state
                    while up:
                        for size in self.shorter.get(up, ()):
                            if size <= seen:
                                names |= self.names[up, size]
                                found = max(found, size)
                        up = self.link[up]
                if found:
                    first, last = start + at + 1 - found, start + at + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, last))
        return spans, names


def _shards(items: DataFrame, text: str, key: str):
    """The items in shards of about SHARD_BYTES of text, one shard held at a time."""
    rows = items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL")
    count = total_bytes(rows, "t") // SHARD_BYTES + 1
    for shard in range(count):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(count)) == shard).collect()]


SPANS = "array<struct<start: long, stop: long>>"


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents with _n_words, _spans (start and stop in words, merged) and _item_ids (as text, sorted).

    Every document is scanned whole. Null and empty texts have no words and no hits; equal items are
    all named, items without an id hit but have no name; an empty benchmark hits nothing. Repeated
    rows are scanned each, and other columns pass through. Where a column has one of the added names
    already, the added one has more underscores (`added_names`).
    """
    n_words, spans, item_ids = names = added_names(docs)
    frame = docs.withColumns({
        n_words: F.lit(0).cast("long"), spans: F.expr(f"cast(array() AS {SPANS})"), item_ids: F.expr("cast(array() AS array<string>)"),
    })
    sent = None
    for shard in _shards(items, item_text, item_key):
        if sent is not None:  # the pass before is done, and its shard no longer needed
            frame = written(frame)
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(shard)
        frame = frame.mapInArrow(_pass(sent, window, text, names), frame.schema)
    return frame


def added_names(docs: DataFrame) -> tuple[str, str, str]:
    """The names of the columns that `scan` adds to a table."""
    return fresh_name(docs, "n_words"), fresh_name(docs, "spans"), fresh_name(docs, "item_ids")


def _pass(sent, window: int, text: str, added: tuple[str, str, str]):
    def run(batches):
        machine = Automaton([(name, words_of(t)) for name, t in sent.value], window)
        for batch in batches:
            counts, spans, names = [], [], []
            earlier = zip(batch.column(added[1]).to_pylist(), batch.column(added[2]).to_pylist(), strict=True)
            for t, (was, were) in zip(batch.column(text).to_pylist(), earlier, strict=True):
                words = words_of(t)
                found, named = machine.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in merged(found + [(x["start"], x["stop"]) for x in was])])
                names.append(sorted({*were, *map(str, named)}))
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in added]
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            made = [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=batch.schema.names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """The documents without their hit spans; those with more than `coverage` of their words hit go whole.

    The columns stay as they are, but for the text and, where there is one, n_chars.
    """
    found = scan(docs, items, window, text)
    n_words, held, _ = added_names(docs)
    n_hit = F.aggregate(held, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    found = found.filter(n_hit <= coverage * F.col(n_words))

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(text).to_pylist(), batch.column(held).to_pylist(), strict=True)
            texts = [cut(t, [(x["start"], x["stop"]) for x in spans]) if spans else t for t, spans in pairs]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, batch.schema.field(text).type))

    clean = found.mapInArrow(run, found.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(held) > 0, F.length(text)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), items, window)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
