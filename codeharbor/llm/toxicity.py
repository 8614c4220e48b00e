"""Toxicity by compression distance: how much shorter does a toxic dictionary make each window?

Two zstandard dictionaries are learnt from labelled text: their content is what one class says far
more often than the other. A window is one word, padded so that the compressor may match to its end;
it is compressed with either dictionary, and the difference in length says which class it is closer
to. A document's differences give a few features, and a logistic threshold is calibrated on other
labelled documents than the dictionaries were learnt from.

Labelled rows are sampled for the fit, at most SAMPLE of each class for each of the two parts, by
the hash of their id; that bounds what is broadcast and what comes to the driver. Every document is
scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import fold, fresh_name, written
from codeharbor.llm.decontaminate import words_of

FOLDS, HELD_OUT = 3, 1
SAMPLE, ENTRIES, LEAST_DOCS, LEAST_SHARE, RATIO = 6000, 200, 3, 0.01, 20.0
LEVEL, THRESHOLD = 3, 0.7
CACHE, LONGEST_KNOWN = 200_000, 64  # words a task keeps, and the bytes of the longest
PAD = b" ~~~~~~~~~~~~"
STEPS = (2, 3, 4, 5)


@dataclass
class Model:
    """toxic, ordinary: dictionary content; weights: of the features, the last one a constant."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] | None


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters.from_level(
        LEVEL, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS
    )
    # the compressor finds nothing in the last bytes of a dictionary, so they are filled up
    made = zstd.ZstdCompressionDict(content + b"\n" * 16, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=made, compression_params=params)


class Windows:
    """Length differences of windows, kept for the words seen lately."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary, self.known = _compressor(model.toxic), _compressor(model.ordinary), {}

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = set(words).difference(self.known)
        for w in fresh:
            window = b" " + w + PAD
            self.known[w] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        gain = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for w in fresh:
            if len(w) > LONGEST_KNOWN:
                del self.known[w]
        if not len(gain):
            return [0.0] * (1 + 2 * len(STEPS)) + [1.0]
        counts = [int((gain >= s).sum()) for s in STEPS]
        return [max(0.0, float(gain.max())), *np.log1p(counts).tolist(), *(50.0 * c / len(gain) for c in counts), 1.0]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        v = w * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
    return beta


def _sketches(batches):
    """The key, the class and the smallest hash of two words in a row: near copies mostly share it."""
    for batch in batches:
        out = []
        for t in batch.column(2).to_pylist():
            words = words_of(t)
            pairs = map(b"%b %b".__mod__, zip(words, words[1:], strict=False)) if len(words) > 1 else [b" ".join(words)]
            out.append(min(map(xxhash.xxh64_intdigest, pairs)))
        made = pa.array(np.array(out, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["k", "y", "s"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from labelled documents outside the held-out fold.

    Labels other than 0 and 1 and those of unknown documents count for nothing; a document labelled
    twice is toxic if one label says so. Without both classes nothing is learnt: every score is 0.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    marks = marks.withColumn("part", fold(F.col("k"), FOLDS)).filter(F.col("part") != HELD_OUT)
    totals = {(r["part"], r["y"]): r["n"] for r in marks.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    sample = None
    for part, y in totals:
        some = marks.filter((F.col("part") == part) & (F.col("y") == y)).orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
        sample = some if sample is None else sample.unionByName(some)
    if len(totals) < 4:
        return Model(b"", b"", None)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.join(F.broadcast(sample), "k")  # at most 4 x SAMPLE short rows
    # of documents with one key the one with the smallest text: what follows is bounded by the sample, too
    rows = written(rows.groupBy("k", "y", "part").agg(F.min(F.coalesce("t", F.lit(""))).alias("t")))
    learn_part, tune_part = (p for p in range(FOLDS) if p != HELD_OUT)

    def distinct_words(batches):
        for batch in batches:
            sets = [sorted(set(words_of(t))) for t in batch.column(0).to_pylist()]
            marks_of = np.repeat(np.array(batch.column(1).to_pylist(), np.int32), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array([w for s in sets for w in s], pa.binary()), pa.array(marks_of, pa.int32())], names=["w", "y"])

    learn = rows.filter(F.col("part") == learn_part).select("k", "y", "t")
    # copies of one text would make its chance words look typical of its class: one of each counts
    kind = learn.schema["k"].dataType.simpleString()
    once = learn.mapInArrow(_sketches, f"k {kind}, y int, s long").groupBy("s", "y").agg(F.min("k").alias("k")).select("k", "y").cache()
    held = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = (held.get(y, 0) for y in (1, 0))
    learn = learn.join(F.broadcast(once), ["k", "y"])  # at most 2 x SAMPLE short rows
    counts = learn.select("t", "y").mapInArrow(distinct_words, "w binary, y int").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    counts = counts.filter(f"length(w) BETWEEN 3 AND 64 AND n >= {LEAST_DOCS}").withColumn("b", F.expr("n - a"))

    def entries(mine: str, other: str, n_mine: int, n_other: int) -> bytes:
        odds = F.expr(f"(({mine} + 0.5) / {n_mine + 1}) / (({other} + 0.5) / {n_other + 1})")
        often = F.col(mine) >= max(LEAST_DOCS, LEAST_SHARE * n_mine)
        ratio = RATIO if mine == "a" else 1.0
        top = counts.filter(often & (odds * n_other / (n_other + 1) >= min(ratio, 0.5 * n_other))).orderBy(F.desc(F.col(mine) * F.log(odds)), "w").limit(ENTRIES)
        return b"".join(b" " + bytes(r["w"]) for r in reversed(top.collect())) + b" "

    counts = counts.cache()
    model = Model(entries("a", "b", n_toxic, n_ordinary), entries("b", "a", n_ordinary, n_toxic), None)
    counts.unpersist()
    once.unpersist()
    tune = rows.filter(F.col("part") == tune_part).select("t", "y")

    def tuned(batches):
        windows = Windows(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([windows.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    seen = tune.mapInArrow(tuned, "x array<double>, y int").toPandas()  # at most 2 x SAMPLE rows
    order = sorted(range(len(seen)), key=lambda i: (seen["y"][i], tuple(seen["x"][i])))  # whatever the order of the tasks
    seen = seen.iloc[order].reset_index(drop=True)
    if seen["y"].nunique() < 2:
        return Model(b"", b"", None)
    x, y = np.array(seen["x"].tolist()), seen["y"].to_numpy(np.float64)
    share = {c: totals[tune_part, c] / max(1, (y == c).sum()) for c in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    model.weights = _logistic(x, y, w * len(y) / w.sum()).tolist()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with _score, from 0 to 1; null and empty texts are scored as texts without words.

    Where a column has that name already, the added one has more underscores.
    """
    added = fresh_name(docs, "score")

    def run(batches):
        windows = Windows(model)
        weights = None if model.weights is None else np.array(model.weights)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if weights is None:
                made = np.zeros(len(texts))
            else:
                x = np.array([windows.features(t) for t in texts]).reshape(len(texts), len(weights))
                made = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], names=batch.schema.names)

    frame = docs.withColumn(added, F.lit(0.0))
    return frame.mapInArrow(run, frame.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, as they are."""
    return score(docs, train(docs, labels)).filter(F.col(fresh_name(docs, "score")) < THRESHOLD).select(*docs.columns)
