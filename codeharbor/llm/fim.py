"""Fill-in-the-middle: texts cut at unit boundaries, which a wavelet matrix over character classes finds.

Every code point has a symbol of three bits: its class (space, line end, digit, other) and whether a
run of spaces or of non-spaces ends there. A wavelet matrix holds the symbols of a stretch of texts.
How many units end in a range is a sum of ranks over the symbols that end that unit; the place where
the t-th unit ends is a select where one symbol ends it, else a bisection on those summed ranks, for
all cuts of the stretch at once.

A token is a run of spaces with the run of non-spaces after it, so it ends where a non-space run does,
and with the text where spaces are left over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BITS = 3
SPACE, LINE, DIGIT, OTHER, ENDS = 0, 1, 2, 3, 4  # ENDS marks the last code point of its run
CLASSES = (SPACE, LINE, DIGIT, OTHER)
#: The symbols that end a unit; a rest without one is a unit of its own.
UNITS = {
    "char": tuple(c | e for c in CLASSES for e in (0, ENDS)),
    "token": (DIGIT | ENDS, OTHER | ENDS),
    "line": (LINE, LINE | ENDS),
}
STRETCH = 1 << 21  # code points that share one matrix; a longer text has its own

_CLASS = np.full(128, OTHER, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = LINE
_CLASS[48:58] = DIGIT


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts laid end to end; ends: where each text ends."""
    kind = _CLASS[np.minimum(points, 127)]
    spaces = kind <= LINE
    last = np.empty(len(points), bool)
    last[:-1] = spaces[1:] != spaces[:-1]
    last[ends[ends > 0] - 1] = True
    return kind | (last * np.uint8(ENDS))


class WaveletMatrix:
    """Symbols by bit levels, highest first; at each level zeros go before ones, in their order."""

    def __init__(self, text: np.ndarray, bits: int = BITS):
        self.size, self.bits, self.ones, self.zeros = len(text), bits, [], []
        rest = text
        for level in range(bits - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            counts = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(bit) - int(counts[-1]))
            rest = np.concatenate((rest[~bit], rest[bit]))

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            at = zeros + ones[at] if symbol >> (self.bits - 1 - k) & 1 else at - ones[at]
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        return self._down(symbol, at) - self._down(symbol, np.zeros(1, np.int64))

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """The place of the nth symbol, counted from 0; it must be there."""
        at = nth + self._down(symbol, np.zeros(1, np.int64))
        for k in range(self.bits - 1, -1, -1):
            ones, zeros = self.ones[k], self.zeros[k]
            if symbol >> (self.bits - 1 - k) & 1:
                at = np.searchsorted(ones, at - zeros + 1, side="left") - 1
            else:
                low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
                while (open_ := low < high).any():  # the least place with more zeros before it than wanted
                    mid = (low + high) >> 1
                    enough = mid - ones[mid] > at
                    high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
                at = low - 1
        return at


class Units:
    """Unit counts and ends in texts laid end to end."""

    def __init__(self, points: np.ndarray, ends: np.ndarray, unit: str = "token"):
        text = symbols(points, ends)
        self.matrix, self.marks = WaveletMatrix(text), UNITS[unit]
        self.starts, self.ends = np.concatenate(([0], ends[:-1])), ends
        self.before = self._ended(self.starts)
        self.ended = self._ended(ends) - self.before
        closed = np.isin(text[np.maximum(ends - 1, 0)], self.marks) if len(text) else np.zeros(len(ends), bool)
        self.count = self.ended + ((ends > self.starts) & ~closed)

    def _ended(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(s, at) for s in self.marks)

    def end_of(self, nth: np.ndarray) -> np.ndarray:
        """Per text, the code points up to the end of its first nth units."""
        goal = self.before + np.minimum(nth, self.ended)
        if len(self.marks) == 1:
            made = self.matrix.select(self.marks[0], np.maximum(goal - 1, 0)) + 1
        else:
            low, high = self.starts.copy(), self.ends.copy()
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                enough = self._ended(mid) >= goal
                high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
            made = low
        made = np.where(nth > self.ended, self.ends, made)
        return np.where(nth <= 0, self.starts, made) - self.starts


def _stretches(texts: list[str]):
    """Runs of texts of about STRETCH code points together."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > STRETCH:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def cuts(texts: list[str], draws: list[tuple[int, int]], unit: str = "token") -> list[tuple[int, int, int]]:
    """Per text: its units, and the code points before the middle and before the suffix.

    A text's two draws, taken modulo units + 1, say after how many units the cuts are.
    """
    out, at = [], 0
    for part in _stretches(texts):
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        units = Units(points, np.cumsum(np.fromiter(map(len, part), np.int64, len(part))), unit)
        a, b = (np.array(d, np.int64) % (units.count + 1) for d in zip(*draws[at : at + len(part)], strict=True))
        out += zip(units.count.tolist(), units.end_of(np.minimum(a, b)).tolist(), units.end_of(np.maximum(a, b)).tolist(), strict=True)
        at += len(part)
    return out


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "token", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """One row per document: key, n, form, prefix_chars, middle_chars, output.

    rate and spm_rate are percentages: of texts that are cut at all, and of these in suffix-first form.
    The choice is a hash of seed and key, so a repeated run or row gives the same; a null key hashes as
    the empty text. Null texts are empty; empty texts and those that hold a sentinel stay plain, with
    null lengths. Texts are never split over tasks; a stretch of texts bounds memory, or the longest text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    draws = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    marked = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(key).alias("k"), whole.alias("t"), digest.alias("h")).select("k", "t", *draws).select("k", "t", "h1", "h2", form.alias("form"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, forms = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            found = cuts(texts, list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), unit)
            made = []
            for t, f, (_, a, b) in zip(texts, forms, found, strict=True):
                if f == "plain":
                    made.append((None, None, t))
                elif f == "spm":
                    made.append((a, b - a, "".join((SUFFIX, t[b:], PREFIX, t[:a], MIDDLE, t[a:b]))))
                else:
                    made.append((a, b - a, "".join((PREFIX, t[:a], SUFFIX, t[b:], MIDDLE, t[a:b]))))
            columns = [pa.array([n for n, _, _ in found], pa.int64()), batch.column(4), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, made).withColumnRenamed("k", key)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. Sentinels cannot overlap text, so the first of each counts."""

    def parts(first: str, second: str) -> list[Column]:
        rest = F.substring(output, len(first) + 1, F.length(output))
        head = F.substring_index(rest, second, 1)
        tail = F.substring(rest, F.length(head) + len(second) + 1, F.length(rest))
        body = F.substring_index(tail, MIDDLE, 1)
        return [head, body, F.substring(tail, F.length(body) + len(MIDDLE) + 1, F.length(tail))]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """The transformed documents, with hashes of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
