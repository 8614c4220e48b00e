"""Order-preserving packing of tokenized documents into sequences of bounded length.

Documents keep their order. A sequence is a window over the running token stream; windows end at
document or sentence ends, or every STEP tokens inside a sentence of more than twice that. Dynamic
programming picks the window ends that minimise padding plus a penalty for each document cut: with
f(j) the least cost up to boundary j at token x_j, f(j) = penalty_j - x_j + size + min (f(i) + x_i)
over x_j - size <= x_i < x_j, and a monotone queue holds that minimum.

The input is split by ranges of the key, so blocks pack independently; each closes one last,
part-filled sequence. A block is worked off in stretches of STRETCH tokens to bound memory.
"""

from __future__ import annotations

import json
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import block_count

SIZE, END_ID, SENTENCE_PENALTY, STEP, STEP_PENALTY = 2048, 1, 8, 32, 24
STRETCH, CACHE, LONGEST_CACHED = 1 << 21, 300_000, 64
# the split pattern of the byte-level vocabulary, as its README gives it
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOOSE = re.compile(r" (?:\s|\Z)")


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary file, with the ids of recent words kept.

    A space before a non-space always begins a new word of the split pattern, so a text without other
    spaces falls apart into words that can be encoded alone; any other text is encoded whole. The string
    of a special token in a text is that token, as the tokenizer's file says.
    """

    def __init__(self, vocabulary: str):
        spec, byte_of = json.loads(vocabulary), _byte_of()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 2, np.int64)
        self.closes = np.zeros(len(self.sizes), bool)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
            self.closes[i] = token.endswith((b".", b"!", b"?", b"\n", "。".encode()[-1:]))
        self.known: dict[str, bytes] = {}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _whole(self, text: str) -> bytes:
        if not self.cut:
            return np.array(self.bpe.encode_ordinary(text), np.uint32).tobytes()
        parts = self.cut.split(text)  # special tokens stand at the odd places
        return b"".join(np.array([self.special[p]] if i % 2 else self.bpe.encode_ordinary(p), np.uint32).tobytes() for i, p in enumerate(parts))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null and empty texts have none."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, split = self.known, []  # per text: what is encoded already, and the words, without their space, still to look up
        for t in texts:
            if not t or _LOOSE.search(t) or (self.cut and self.cut.search(t)):
                split.append((self._whole(t or ""), ()))
            else:
                first, *rest = t.split(" ")
                split.append((self._whole(first), rest))
        fresh = set().union(*(rest for _, rest in split)).difference(known)
        long = [w for w in fresh if len(w) > LONGEST_CACHED]
        known.update((w, self._whole(" " + w)) for w in long)
        if short := [w for w in fresh if len(w) <= LONGEST_CACHED]:
            joined = " " + " ".join(short)
            ids = np.array(self.bpe.encode_ordinary(joined), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, short)), np.int64, len(short)) + 1)
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            raw = ids.tobytes()
            known.update(zip(short, map(raw.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist())), strict=True))
        out = [b"".join((head, *map(known.__getitem__, rest))) for head, rest in split]
        for w in long:
            del known[w]
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def windows(ends: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """The window ends of least cost among `ends` (ascending, at most `size` apart, from 0 exclusive)."""
    xs, back = [0, *ends.tolist()], [0]
    queue, values = deque([0]), deque([0])  # boundaries that may still start a window, and their f(i) + x_i, rising
    for j, (x, extra) in enumerate(zip(xs[1:], (penalties + size).tolist(), strict=True), 1):
        while xs[queue[0]] < x - size:
            values.popleft()
            queue.popleft()
        back.append(queue[0])
        g = values[0] + extra  # f(j) + x_j
        while values and values[-1] >= g:
            values.pop()
            queue.pop()
        values.append(g)
        queue.append(j)
    out, j = [], len(xs) - 1
    while j:
        out.append(xs[j])
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of each: document ends, sentence ends, steps in long gaps."""
    marks = np.full(len(ids) + 1, -1, np.int16)
    sentence = np.flatnonzero(closes[np.minimum(ids, len(closes) - 1)]) + 1
    marks[sentence[np.diff(sentence // STEP, append=-1) != 0]] = SENTENCE_PENALTY  # the last of each STEP tokens
    marks[doc_ends] = 0
    at = np.flatnonzero(marks >= 0)
    starts = np.concatenate(([0], at[:-1]))
    wide = np.flatnonzero(at - starts > 2 * STEP)
    for a, b in zip(starts[wide].tolist(), at[wide].tolist(), strict=True):
        marks[a + STEP : b : STEP] = STEP_PENALTY
    filled = np.flatnonzero(marks >= 0)
    cost = marks[filled]
    return filled, cost


def _pieces(keys: list, raw: list[bytes], closes: np.ndarray, size: int, first: int, schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
    """The pieces of one stretch of documents, and the number of sequences made."""
    data = b"".join(raw)
    ids = np.frombuffer(data, np.uint32)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    doc_ends = np.cumsum(lengths)
    cuts = np.array(windows(*boundaries(ids, doc_ends, closes, size), size), np.int64)
    edges = np.concatenate(([0], np.union1d(cuts, doc_ends)))
    start, stop = edges[:-1], edges[1:]
    doc, seq = np.searchsorted(doc_ends, start, side="right"), np.searchsorted(cuts, start, side="right")
    seq_start = np.concatenate(([0], cuts))[seq]
    offsets = pa.py_buffer((edges * 4).astype(np.int32).tobytes())
    columns = [
        pa.array(keys, schema.field(0).type).take(pa.array(doc)), pa.array(start - (doc_ends - lengths)[doc]), pa.array(stop - start),
        pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(data)]), pa.array(lengths[doc]),
        pa.array(seq + first), pa.array(start - seq_start),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema), len(cuts)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    vocabulary is the content of a byte-level tokenizer file. Each document is its ids and END_ID, so a
    null or empty text is one token. Repeated keys are documents of their own, in the order of a hash of
    their text; equal rows are too. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    order = ["k", F.xxhash64("t"), "t"]  # the texts of one key may be many tasks'
    rows = rows.repartitionByRange(block_count(rows, "t"), *order[:2]).sortWithinPartitions(*order)
    end = np.array([END_ID], np.uint32).tobytes()
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        encode, first, count, keys, raw = encoder(vocabulary), TaskContext.get().partitionId() << 32, 0, [], []
        schema = None
        for batch in batches:
            if schema is None:
                longs = [(n, pa.int64()) for n in ("start", "length")]
                schema = pa.schema([("k", batch.schema.field(0).type), *longs, ("ids", pa.binary()), *[(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]])
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [ids + end for ids in encode(part.column(1).to_pylist())]
                keys += part.column(0).to_pylist()
                raw += made
                count += sum(map(len, made)) // 4
                if count >= STRETCH:
                    out, n = _pieces(keys, raw, encode.closes, size, first, schema)
                    first, count, keys, raw = first + n, 0, [], []
                    yield out
        if keys:
            yield _pieces(keys, raw, encode.closes, size, first, schema)[0]

    made = f"k {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, made).withColumnRenamed("k", key)


def vocabulary_text(path: str | None = None) -> str:
    """The content of a tokenizer file on the driver; a public byte-level vocabulary unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
