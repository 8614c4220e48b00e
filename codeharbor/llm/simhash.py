"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits maps to the bit counts of its 32 segments of two bits. Fingerprints that
differ in d bits lie within Manhattan distance d of each other there, so a range join on a grid
over that space finds every pair, and the exact distance then decides. The 32 coordinates fall into
two halves; for a distance up to 3, one half lies within distance 1. Each fingerprint therefore
stands in one cell per half and looks into its own cell and those one step up; a step down is the
other one's step up. Copies meet first: only different fingerprints are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import components, fresh_name, written

WIDTH, SEED, CHUNK = 3, 42, 1 << 16
RADIUS = 3
ODD = 0x55555555


def fingerprint(text: str | None) -> int:
    """64 majority bits over the hashes of the word shingles; 0 without words or for null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= WIDTH:
        starts, ends = starts[: len(words) - WIDTH + 1], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):  # a very long text needs no more memory than a chunk
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) with the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["k", "fp"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _steps(half: str) -> str:
    """The cell of a half and those one step up in one of its 16 coordinates (counts 0 to 2)."""
    up = f"filter(transform(sequence(0, 15), i -> if((shiftright({half}, 2 * i) & 3) < 2, {half} + shiftleft(1L, 2 * i), -1L)), x -> x >= 0)"
    return f"concat(array({half}), {up})"


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b for every two different fingerprints at most RADIUS bits apart, from (fp)."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    cells = prints.select("fp", *[F.expr(f"({x} & {ODD}L) + (shiftright({x}, 1) & {ODD}L)").alias(h) for x, h in ((low, "h0"), (high, "h1"))])
    stand = cells.selectExpr("fp AS b", "h0 AS b0", "h1 AS b1", "inline(array(struct(0 AS half, h0 AS cell), struct(1 AS half, h1 AS cell)))")
    look = cells.select(
        F.col("fp").alias("a"), F.col("h0").alias("a0"), F.col("h1").alias("a1"),
        F.posexplode(F.expr(f"array({_steps('h0')}, {_steps('h1')})")).alias("half", "near"),
    ).select("a", "a0", "a1", "half", F.explode("near").alias("cell"))
    apart = " + ".join(f"abs((shiftright(a{h}, {i}) & 3) - (shiftright(b{h}, {i}) & 3))" for h in (0, 1) for i in range(0, 32, 2))
    met = look.join(stand, ["half", "cell"]).filter("a <> b")
    met = met.filter(f"{apart} <= {RADIUS}").filter(f"bit_count(a ^ b) <= {RADIUS}")
    return met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def _classes(prints: DataFrame, least: Column) -> DataFrame:
    """(fp, component, low) of prints(fp, ...): its component of linked fingerprints, and the least of
    `least` over the component's rows."""
    groups = components(links(prints.select("fp").distinct()))
    own = prints.groupBy("fp").agg(F.min(least).alias("low"))
    own = written(own.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))
    lows = own.groupBy("component").agg(F.min("low").alias("low"))
    return own.drop("low").join(lows, "component")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    Null and blank texts have fingerprint zero and are linked like any other; repeated rows stay; a
    null key never names a component unless the component has no other. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, text, key))
    classes = _classes(prints, F.col(key)).select("fp", F.col("low").alias("component_id"))
    return prints.join(classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of `near_duplicates`, columns as they are: the one with the smallest
    key, of its rows the one with the smallest text, of equal ones any.

    Rows without a key come after all others. Null and blank texts are near copies of each other, so one
    of them stays. An empty table stays empty.
    """
    whole, held = (fresh_name(docs, n) for n in ("row", "held"))
    name = F.struct(F.col(key).isNull().alias("a"), F.col(key).alias("b"), F.xxhash64(text, F.lit(1)).alias("c"), F.xxhash64(text, F.lit(2)).alias("d"))
    prints = written(fingerprints(docs.select(name.alias("doc_id"), F.col(text).alias("text"))))
    kept = _classes(prints, F.col("doc_id")).select(F.col("low").alias(held)).distinct()
    rows = docs.select(name.alias(held), F.struct(*[docs[c] for c in docs.columns]).alias(whole))
    return rows.join(kept, held, "left_semi").groupBy(held).agg(F.first(whole).alias(whole)).select(f"{whole}.*")
