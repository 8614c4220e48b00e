"""Merkle manifest of a dataset: a persistent tree whose versions share every untouched node.

A tree (one per source, and one over the sources' roots) has up to ARITY nodes below each node. Its
nodes lie in aligned blocks: a block holds ARITY**2 neighbours of one level, the nodes above them and
their common root, so it is one bounded row and a hot source is many rows. Block roots are the nodes
of the next round, until one is left per tree.

A changed leaf makes a version: the nodes on its path are copied within its block, everything beside
the path is the base version's, and the block root's copy goes on upwards along the shared siblings of
the upper rounds, which stand once per block, not once per document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeharbor.llm.common import ascii_lower, written

ARITY = 16
BLOCK = ARITY**2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5
PATH = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    return sha(F.concat(*[field(v) for v in values.values()]))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _block(digests: list[str], size: int) -> list[list[str]]:
    """Levels of an aligned block, lowest first, for a tree of `size` nodes on the lowest one."""
    made = [digests]
    for _ in range(0 if size == 1 else 1 if size <= ARITY else 2):
        low = made[-1]
        made.append([_hash("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return made


def _path(nodes: list[list[str]], at: int) -> list[dict[str, str]]:
    """What stands beside the path from a node to the root of its block, lowest first."""
    out = []
    for level in nodes[:-1]:
        run = at - at % ARITY
        out.append({"left": "".join(level[run:at]), "right": "".join(level[at + 1 : run + ARITY])})
        at //= ARITY
    return out


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with `at`, the place in their tree by `order`, and `size`, the rows of that tree.

    Rows are ranged by tree and order, so a hot tree is spread; only one count per tree and range is
    summed up over the ranges.
    """
    keys = [F.col(tree), *map(F.col, order)]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = written(spread.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    parts = spread.groupBy(F.col(tree).alias("tree_"), F.col("range").alias("range_")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    by_tree = Window.partitionBy("tree_")
    before = F.sum("n").over(by_tree.orderBy("range_")) - F.col("n")
    offsets = parts.select("tree_", "range_", (before - F.col("first")).alias("shift"), F.sum("n").over(by_tree).alias("size"))
    same = spread[tree].eqNullSafe(offsets["tree_"]) & (spread["range"] == offsets["range_"])
    return spread.join(offsets, same).withColumn("at", F.col("place") + F.col("shift")).drop("tree_", "range_", "range", "place", "shift")


@dataclass
class Manifest:
    """rounds: block tables, lowest first: tree, block, size and nodes, the block's rows in order.

    roots: one row per tree with its root.
    """

    rounds: list[DataFrame]
    roots: DataFrame


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows(tree, at, size, digest, ...): trees of nodes numbered from 0.

    Other columns of rows stay with their node in the lowest blocks.
    """
    rounds, roots = [], None
    while True:
        row = F.struct("at", *[c for c in rows.columns if c not in ("tree", "at", "size")])
        blocks = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
        blocks = written(blocks.agg(F.first("size").alias("size"), F.sort_array(F.collect_list(row)).alias("nodes")))
        rounds.append(blocks)
        above = written(_block_roots(blocks))
        done = above.filter(f"size <= {BLOCK}").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.union(done)
        rows = above.filter(f"size > {BLOCK}").withColumn("size", F.ceil(F.col("size") / BLOCK))
        if rows.isEmpty():
            return Manifest(rounds, roots)


def _block_roots(blocks: DataFrame) -> DataFrame:
    """(tree, at, size, digest): the root of each block; a lone node is its own root."""

    def run(batches):
        for batch in batches:
            made = []
            for digests, size in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made.append(_block(digests, size)[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["tree", "at", "size", "digest"])

    rows = blocks.select("tree", F.col("block").alias("at"), "size", F.col("nodes.digest").alias("d"))
    kind = rows.schema["tree"].dataType.simpleString()
    return rows.mapInArrow(run, f"tree {kind}, at long, size long, digest string")


def upper_paths(manifest: Manifest, above: DataFrame) -> DataFrame:
    """The lowest blocks with `path`, the siblings from the block's root to the top, and `tops`.

    above has, per tree, the path that goes on from its root, and tops. The rounds are walked from the
    top; each is a share of 1 / BLOCK of the one below.
    """
    paths, made = None, None
    for number, blocks in reversed([*enumerate(manifest.rounds)]):
        there = above.withColumnRenamed("tree", "tree_")
        made = blocks.filter(f"size <= {BLOCK}").join(there, F.col("tree").eqNullSafe(F.col("tree_"))).drop("tree_")
        if paths is not None:
            there = paths.withColumnsRenamed({"tree": "tree_", "at": "block_"})
            same = F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("block_"))
            made = made.unionByName(blocks.filter(f"size > {BLOCK}").join(there, same).drop("tree_", "block_"))
        if number:
            paths = written(node_paths(made))
    return made


def node_paths(blocks: DataFrame) -> DataFrame:
    """(tree, at, path, tops) for each node of blocks(tree, block, size, nodes, path, tops)."""
    rows = blocks.select("tree", "tops", "size", F.col("nodes.at").alias("at"), F.col("nodes.digest").alias("d"), "path")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("tree", "tops")}

    def run(batches):
        for batch in batches:
            size, at, digests, path = (c.to_pylist() for c in batch.columns[2:])
            row, places, out = [], [], []
            for i, (n, ps, ds, rest) in enumerate(zip(size, at, digests, path, strict=True)):
                nodes = _block(ds, n)
                row += [i] * len(ps)
                places += ps
                out += [_path(nodes, j) + rest for j in range(len(ps))]
            taken = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([taken[0], pa.array(places, pa.int64()), pa.array(out, batch.schema.field("path").type), taken[1]], names=["tree", "at", "path", "tops"])

    return rows.mapInArrow(run, f"tree {kinds['tree']}, at long, path {PATH}, tops {kinds['tops']}")


def fold(digest: str, path: list[dict[str, str]]) -> list[str]:
    """The copied nodes of a version, from above the leaf to the root."""
    out = []
    for p in path:
        digest = _hash(p["left"] + digest + p["right"])
        out.append(digest)
    return out


def manifest_of(docs: DataFrame, key: str = "doc_id", group: str = "source") -> tuple[Manifest, Manifest, DataFrame]:
    """The sources' trees, the tree over their roots, and per source the path above its root.

    docs has key, group, digest and changed (the digest of a changed leaf, or null). Leaves of a group
    ascend by key, null first, equal keys by digest; groups ascend too, null first.
    """
    lower = numbered(docs.select(F.col(group).alias("tree"), F.col(key).alias("k"), "digest", "changed"), "tree", ["k", "digest"])
    trees = build(lower)
    subroots = written(trees.roots).select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    forest = build(numbered(subroots, "tree", ["group"]))
    empty = F.expr(f"CAST(array() AS {PATH})")
    top = forest.roots.select("tree", empty.alias("path"), F.col("root").alias("tops"))
    blocks = upper_paths(forest, top)
    members = blocks.select(F.explode("nodes").alias("n")).select("n.at", F.col("n.group").alias("tree"), F.col("n.digest").alias("subroot"))
    above = node_paths(blocks).drop("tree").join(members, "at")
    return trees, forest, written(above.select("tree", "path", F.struct("subroot", F.col("tops").alias("root")).alias("tops")))


def prove(docs: DataFrame, key: str = "doc_id", group: str = "source") -> DataFrame:
    """One row per row of docs(key, group, digest, changed): key, leaf, subroot, root, proof_sha256,
    versions and folded_root.

    The proof lists the siblings of the path from the leaf to the root. `versions` are the nodes that the
    version of a changed leaf copies, lowest first; the last is its root. A leaf that did not change is
    folded in the same way, which gives the base version's root. An empty table gives no rows.
    """
    trees, _, above = manifest_of(docs, key, group)
    blocks = upper_paths(trees, above)
    rows = blocks.select(F.col("nodes.k").alias("k"), "size", F.col("nodes.digest").alias("d"), F.col("nodes.changed").alias("c"), "path", "tops.subroot", "tops.root")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, size, digests, changed, path, subroot, root = (c.to_pylist() for c in batch.columns)
            for ks, n, ds, cs, rest, sub, top in zip(keys, size, digests, changed, path, subroot, root, strict=True):
                nodes = _block(ds, n)
                tail, out = "".join(p["left"] + p["right"] for p in rest), []
                for i, (d, c) in enumerate(zip(ds, cs, strict=True)):
                    own = _path(nodes, i)
                    copies = fold(c or d, own + rest)
                    out.append((ks[i], d, sub, top, _hash("".join(p["left"] + p["right"] for p in own) + tail), copies, copies[-1] if copies else c or d))
                kinds = (batch.schema.field(0).type.value_type, *[pa.string()] * 4, pa.list_(pa.string()), pa.string())
                names = ["k", "leaf", "subroot", "root", "proof_sha256", "versions", "folded_root"]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    made = f"k {kind}, leaf string, subroot string, root string, proof_sha256 string, versions array<string>, folded_root string"
    return rows.mapInArrow(run, made).withColumnRenamed("k", key)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest and changed: where 5 divides the crc32 of the key, A-Z of the text is lower-cased.

    Null fields are dashes, also when tampered; a null key hashes as the empty text for that choice.
    """
    values = {c: F.col(c) for c in FIELDS}
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPER_EVERY == 0
    changed = F.when(tampered, leaf(**values | {"text": ascii_lower(F.col("text").cast("string"))}))
    return docs.select("doc_id", "source", leaf(**values).alias("digest"), changed.alias("changed"))


def report(docs: DataFrame) -> DataFrame:
    """Proofs and folded roots of all documents; verified is true where the folded root is the root."""
    made = prove(written(leaves(docs)))
    return made.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
