"""Nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node. Nodes live in blocks of about BLOCK, one row of packed arrays each: ids,
unit vectors, and per node its K best neighbours so far. A message between nodes is a packed array
sent to a block, so a step is a Spark join of blocks with their mail.

* Seeding: chunks of CHUNK nodes that follow each other along a random direction give first neighbours.
* NN-descent round: nodes send themselves to their neighbours, so each node has a list of those it
  points to and those that point to it, at most LIST of either; it fetches their vectors, and every
  pair of the list with a new member is a candidate edge. Blocks keep the K best per node. Rounds end
  when at most a share SETTLED of the edges is new.
* Search: a query starts at its own node and keeps the best nodes seen. Each round it opens up to STEP
  of the BEAM best that are not open yet, and measures the neighbours of those that it has not met.
  It ends when the BEAM best are all open. The measure of the answers is taken again in doubles.

Lists and beam bound the work per node and query; every node is indexed and may be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeharbor.llm.common import written

K, LIST, CHUNK, SEEDINGS, BEAM, STEP, BLOCK, FINALISTS = 32, 24, 2048, 3, 192, 96, 4096, 16
SETTLED = 0.01  # rounds end when at most this share of the graph's edges is new
GRAPH = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("nbrs", pa.binary()), ("sims", pa.binary()), ("fresh", pa.binary())])
MAIL = pa.schema([("block", pa.int64()), ("home", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
STATE = pa.schema([("home", pa.int64()), ("q", pa.int64()), ("vec", pa.binary()), ("seen", pa.binary()), ("pool", pa.binary()), ("sims", pa.binary()), ("done", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _by_block(blocks_of: np.ndarray):
    """(block, positions) for every block that occurs."""
    order = np.argsort(blocks_of, kind="stable")
    at = np.flatnonzero(np.diff(blocks_of[order], prepend=-1))
    for part in np.split(order, at[1:]) if len(at) else ():
        yield int(blocks_of[part[0]]), part


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _batches(rows: list[dict], schema: pa.Schema):
    yield from _table(rows, schema).to_batches()


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one vector of doubles for each key, of the most frequent length, finite and not zero."""
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    kept = kept.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    usual = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("v") == (usual["n"] if usual else 0)).groupBy("id").agg(F.min("v").alias("v"))


def distinct_nodes(rows: DataFrame, members: int) -> DataFrame:
    """(id, v, members): one node per different vector of rows(id, v), with its smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= members)  # limited before the shuffle as well
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("id"), "v", "members")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of the squares
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _load(row: dict, dim: int):
    """ids, vectors, neighbours, similarities and news of a packed block; ids ascend, neighbours fall."""
    ids = np.frombuffer(row["ids"], np.int64)
    vecs = np.frombuffer(row["vecs"], np.float32).reshape(-1, dim)
    return ids, vecs, *(np.frombuffer(row[c], t).reshape(-1, K) for c, t in (("nbrs", np.int64), ("sims", np.float32), ("fresh", np.bool_)))


def _packed_blocks(nodes: DataFrame, blocks: int, dim: int) -> DataFrame:
    def spread(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vecs = _matrix(batch.column(1)) if batch.num_rows else np.empty((0, dim), np.float32)
            yield from _batches([{"block": b, "ids": ids[p].tobytes(), "vecs": vecs[p].tobytes()} for b, p in _by_block(_block_of(ids, blocks))], GRAPH)

    def pack(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
        vecs = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, dim) for x in table["vecs"].to_pylist()])
        order, n = np.argsort(ids), len(ids)
        return _table([{
            "block": table["block"][0].as_py(), "ids": ids[order].tobytes(), "vecs": vecs[order].tobytes(), "nbrs": np.full((n, K), -1, np.int64).tobytes(),
            "sims": np.full((n, K), -2, np.float32).tobytes(), "fresh": np.zeros((n, K), bool).tobytes(),
        }], GRAPH)

    return nodes.select("id", "v").mapInArrow(spread, _ddl(GRAPH)).groupBy("block").applyInArrow(pack, _ddl(GRAPH))


def _seeds(nodes: DataFrame, count: int, blocks: int, dim: int, seed: int) -> DataFrame:
    """Candidate edges inside chunks of nodes that follow each other along a random direction."""
    direction = np.random.default_rng(seed).standard_normal(dim).tolist()
    along = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in direction]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ranged = nodes.select("id", "v", (along / size).alias("p")).repartitionByRange(count // (8 * CHUNK) + 1, "p", "id").sortWithinPartitions("p", "id")

    def run(batches):
        got = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
        if not got:
            return
        ids, vecs = (np.concatenate(x) for x in zip(*got, strict=True))
        for part in np.array_split(np.arange(len(ids)), -(-len(ids) // CHUNK)):
            k = min(K, len(part) - 1)
            if k < 1:
                continue
            sims = vecs[part] @ vecs[part].T
            np.fill_diagonal(sims, -3)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            u, v, s = np.repeat(ids[part], k), ids[part][best].ravel(), np.take_along_axis(sims, best, 1).ravel()
            yield from _batches([{"block": b, "kind": 2, "a": u[p].tobytes(), "b": v[p].tobytes(), "c": s[p].tobytes()} for b, p in _by_block(_block_of(u, blocks))], MAIL)

    return ranged.mapInArrow(run, _ddl(MAIL))


def _merge(dim: int):
    """Blocks with their candidate edges taken in: the K best of each node, new ones marked."""

    def run(graph: pa.Table, mail: pa.Table) -> pa.Table:
        if not graph.num_rows:
            return _table([], GRAPH)
        row = graph.to_pylist()[0]
        ids, _, nbrs, sims, fresh = _load(row, dim)
        rows = mail.to_pylist()
        u = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x["a"], np.int64) for x in rows)])
        v = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x["b"], np.int64) for x in rows)])
        s = np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x["c"], np.float32) for x in rows)])
        have = nbrs.ravel() >= 0
        at = np.concatenate((np.repeat(np.arange(len(ids)), K)[have], np.searchsorted(ids, u)))
        to, sim = np.concatenate((nbrs.ravel()[have], v)), np.concatenate((sims.ravel()[have], s))
        new = np.concatenate((np.zeros(have.sum(), bool), np.ones(len(u), bool)))
        order = np.lexsort((new, to, at))  # an edge that was there stays old
        at, to, sim, new = at[order], to[order], sim[order], new[order]
        once = np.concatenate(([True], (at[1:] != at[:-1]) | (to[1:] != to[:-1])))[: len(at)]
        at, to, sim, new = at[once], to[once], sim[once], new[once]
        order = np.lexsort((to, -sim, at))
        at, to, sim, new = at[order], to[order], sim[order], new[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < K
        out = [np.full((len(ids), K), -1, np.int64), np.full((len(ids), K), -2, np.float32), np.zeros((len(ids), K), bool)]
        for target, values in zip(out, (to, sim, new), strict=True):
            target[at[best], rank[best]] = values[best]
        return _table([row | {c: x.tobytes() for c, x in zip(("nbrs", "sims", "fresh"), out, strict=True)}], GRAPH)

    return run


def _descend(graph: DataFrame, blocks: int, dim: int) -> DataFrame:
    """Candidate edges among the neighbours of each node, by one round of mail."""

    def point(batches):  # every node tells those it points to
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, nbrs, _, fresh = _load(row, dim)
                u, v, new = np.repeat(ids, LIST), nbrs[:, :LIST].ravel(), fresh[:, :LIST].ravel()
                u, v, new = u[v >= 0], v[v >= 0], new[v >= 0]
                yield from _batches([{"block": b, "kind": 0, "a": v[p].tobytes(), "b": u[p].tobytes(), "c": new[p].tobytes()} for b, p in _by_block(_block_of(v, blocks))], MAIL)

    def ask(table: pa.Table, mail: pa.Table) -> pa.Table:  # lists of both directions; where their vectors are
        if not table.num_rows:
            return _table([], MAIL)
        row = table.to_pylist()[0]
        ids, _, nbrs, _, fresh = _load(row, dim)
        rows = mail.to_pylist()
        v, u = (np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x[c], np.int64) for x in rows)]) for c in "ab")
        new = np.concatenate([np.empty(0, bool), *(np.frombuffer(x["c"], np.bool_) for x in rows)])
        mixed = (u ^ v).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.lexsort((u, mixed, v))
        u, v, new = u[order], np.searchsorted(ids, v[order]), new[order]
        some = np.arange(len(v)) - np.searchsorted(v, v) < LIST  # LIST of those that point here, by hash
        n = np.arange(len(ids))
        f = nbrs[:, :LIST] >= 0
        at = np.concatenate((n, np.repeat(n, LIST)[f.ravel()], v[some]))  # the node itself is in its list
        to = np.concatenate((ids, nbrs[:, :LIST][f], u[some]))
        new = np.concatenate((np.zeros(len(ids), bool), fresh[:, :LIST][f], new[some]))
        order = np.lexsort((~new, to, at))
        at, to, new = at[order], to[order], new[order]
        once = np.concatenate(([True], (at[1:] != at[:-1]) | (to[1:] != to[:-1])))
        at, to, new = at[once], to[once], new[once]
        live = np.isin(at, np.unique(at[new]))  # lists without news have been worked off
        at, to, new = at[live], to[live], new[live]
        home = row["block"]
        out = [{"block": home, "home": home, "kind": 0, "a": at.tobytes(), "b": to.tobytes(), "c": new.tobytes()}]
        wanted = np.unique(to)
        out += [{"block": b, "home": home, "kind": 1, "a": wanted[p].tobytes()} for b, p in _by_block(_block_of(wanted, blocks))]
        return _table(out, MAIL)

    def answer(mail: pa.Table, table: pa.Table) -> pa.Table:
        if not mail.num_rows:
            return _table([], MAIL)
        ids, vecs, _, sims, _ = _load(table.to_pylist()[0], dim)
        out = []
        for x in mail.to_pylist():
            if x["kind"]:
                at = np.searchsorted(ids, np.frombuffer(x["a"], np.int64))
                x = x | {"b": vecs[at].tobytes(), "c": sims[at, K - 1].tobytes()}
            out.append(x)
        return _table(out, MAIL)

    def join(mail: pa.Table) -> pa.Table:
        rows = mail.to_pylist()
        lists = next(x for x in rows if x["kind"] == 0)
        got = [x for x in rows if x["kind"] == 1]
        if not got:
            return _table([], MAIL)
        known = np.concatenate([np.frombuffer(x["a"], np.int64) for x in got])
        vecs = np.concatenate([np.frombuffer(x["b"], np.float32) for x in got]).reshape(-1, dim)
        worst = np.concatenate([np.frombuffer(x["c"], np.float32) for x in got])
        order = np.argsort(known)
        known, vecs, worst = known[order], vecs[order], worst[order]
        at, to, new = (np.frombuffer(lists[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.bool_)))
        place = np.searchsorted(known, to)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        edges = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            p, n = place[a:b], new[a:b]
            sims = vecs[p] @ vecs[p].T
            np.fill_diagonal(sims, -3)
            i, j = np.nonzero((sims > worst[p][:, None]) & (n[:, None] | n[None, :]))
            edges.append((p[i], p[j], sims[i, j]))
        u, v, s = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.empty(0, np.int64),) * 3
        pair, first = np.unique(u * len(known) + v, return_index=True)
        u, v, s = known[u[first]], known[v[first]], s[first].astype(np.float32)
        return _table([{"block": b, "kind": 2, "a": u[x].tobytes(), "b": v[x].tobytes(), "c": s[x].tobytes()} for b, x in _by_block(_block_of(u, blocks))], MAIL)

    told = graph.mapInArrow(point, _ddl(MAIL))
    asked = graph.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, _ddl(MAIL))
    answered = asked.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(answer, _ddl(MAIL))
    return answered.groupBy("home").applyInArrow(join, _ddl(MAIL))


def build(nodes: DataFrame, count: int, dim: int, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph of nodes(id, v), in packed blocks; rounds go on until at most a share `settled` of its edges is new."""
    blocks = count // BLOCK + 1
    base = _packed_blocks(nodes, blocks, dim)
    seeds = _seeds(nodes, count, blocks, dim, 0)
    for seed in range(1, SEEDINGS):
        seeds = seeds.union(_seeds(nodes, count, blocks, dim, seed))

    def merged(graph, edges):
        return written(graph.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_merge(dim), _ddl(GRAPH)))

    def news(batches):
        for batch in batches:
            edges = [(int((nbrs >= 0).sum()), int(fresh.sum())) for _, _, nbrs, _, fresh in (_load(row, dim) for row in batch.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["edges", "new"])

    graph = merged(base, seeds)
    while True:
        graph = merged(graph, _descend(graph, blocks, dim))
        had = graph.mapInArrow(news, "edges long, new long").agg(F.sum("edges").alias("edges"), F.sum("new").alias("new")).first()
        if (had["new"] or 0) <= settled * (had["edges"] or 0):
            return graph


def _walk(graph: DataFrame, state: DataFrame, blocks: int, dim: int) -> DataFrame:
    """One round of greedy search."""

    def chosen(x: dict) -> np.ndarray:
        pool, done = np.frombuffer(x["pool"], np.int64), np.frombuffer(x["done"], np.bool_)
        return pool[:BEAM][~done[:BEAM]][:STEP]

    def opened(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                ids = chosen(x)
                out += [{"block": b, "home": x["home"], "kind": 0, "a": np.int64(x["q"]).tobytes(), "b": ids[p].tobytes()} for b, p in _by_block(_block_of(ids, blocks))]
            yield from _batches(out, MAIL)

    def neighbours(mail: pa.Table, table: pa.Table) -> pa.Table:
        if not mail.num_rows:
            return _table([], MAIL)
        ids, _, nbrs, _, _ = _load(table.to_pylist()[0], dim)
        out = []
        for x in mail.to_pylist():
            near = np.unique(nbrs[np.searchsorted(ids, np.frombuffer(x["b"], np.int64))])
            out.append(x | {"b": near[near >= 0].tobytes()})
        return _table(out, MAIL)

    def unmet(states: pa.Table, mail: pa.Table) -> pa.Table:  # the state travels on with the questions
        near: dict[int, list] = {}
        for x in mail.to_pylist():
            near.setdefault(int(np.frombuffer(x["a"], np.int64)[0]), []).append(np.frombuffer(x["b"], np.int64))
        out = []
        for x in states.to_pylist():
            q, seen = np.array([x["q"]]), np.frombuffer(x["seen"], np.int64)
            ids = np.setdiff1d(np.concatenate(near.get(x["q"], [seen[:0]])), seen)
            pool = np.frombuffer(x["pool"], np.int64)
            done = np.frombuffer(x["done"], np.bool_) | np.isin(pool, chosen(x))
            head = {"home": x["home"], "a": q.tobytes(), "b": x["vec"]}
            seen = np.union1d(seen, ids)
            out.append(head | {"block": int(_block_of(q, blocks)[0]), "kind": 0, "c": seen.tobytes(), "d": pool.tobytes() + x["sims"] + done.tobytes()})
            out += [head | {"block": b, "kind": 1, "c": ids[p].tobytes()} for b, p in _by_block(_block_of(ids, blocks))]
        return _table(out, MAIL)

    def measured(mail: pa.Table, table: pa.Table) -> pa.Table:
        if not mail.num_rows:
            return _table([], MAIL)
        out, graph_rows = [], table.to_pylist()
        ids, vecs = _load(graph_rows[0], dim)[:2] if graph_rows else (None, None)
        for x in mail.to_pylist():
            if x["kind"]:
                sims = vecs[np.searchsorted(ids, np.frombuffer(x["c"], np.int64))] @ np.frombuffer(x["b"], np.float32)
                x = x | {"b": None, "d": sims.astype(np.float32).tobytes()}
            out.append(x)
        return _table(out, MAIL)

    def gathered(mail: pa.Table) -> pa.Table:
        rows, found = mail.to_pylist(), {}
        for x in rows:
            if x["kind"]:
                found.setdefault(x["a"], []).append(x)
        out = []
        for x in rows:
            if x["kind"]:
                continue
            more = found.get(x["a"], [])
            n = len(x["d"]) // 13
            pool = np.concatenate([np.frombuffer(x["d"][: 8 * n], np.int64), *(np.frombuffer(y["c"], np.int64) for y in more)])
            sims = np.concatenate([np.frombuffer(x["d"][8 * n : 12 * n], np.float32), *(np.frombuffer(y["d"], np.float32) for y in more)])
            done = np.concatenate([np.frombuffer(x["d"][12 * n :], np.bool_), np.zeros(len(pool) - n, bool)])
            best = np.lexsort((pool, -sims))[:BEAM]
            out.append({
                "home": x["home"], "q": int(np.frombuffer(x["a"], np.int64)[0]), "vec": x["b"], "seen": x["c"], "pool": pool[best].tobytes(),
                "sims": sims[best].tobytes(), "done": done[best].tobytes(),
            })
        return _table(out, STATE)

    asked = state.mapInArrow(opened, _ddl(MAIL))
    near = asked.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(neighbours, _ddl(MAIL))
    questions = state.groupBy("home").cogroup(near.groupBy("home")).applyInArrow(unmet, _ddl(MAIL))
    answers = questions.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(measured, _ddl(MAIL))
    return answers.groupBy("home").applyInArrow(gathered, _ddl(STATE))


def search(graph: DataFrame, starts: DataFrame, count: int, n_queries: int, dim: int) -> DataFrame:
    """(q, node): the FINALISTS best nodes that greedy search finds for each start(id, v), a node itself."""
    blocks, homes = count // BLOCK + 1, n_queries // 256 + 1

    def begin(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column(0).to_numpy(), _matrix(batch.column(1))
            one, at = np.ones(1, np.float32).tobytes(), _block_of(ids, homes).tolist()
            yield from _batches([
                {"home": h, "q": q, "vec": v.tobytes(), "seen": np.int64(q).tobytes(), "pool": np.int64(q).tobytes(), "sims": one, "done": b"\0"}
                for h, q, v in zip(at, ids.tolist(), vecs, strict=True)
            ], STATE)

    state = written(starts.select("id", "v").mapInArrow(begin, _ddl(STATE)))
    ended = None
    while not state.isEmpty():
        state = written(_walk(graph, state, blocks, dim))
        closed = ~F.contains(F.substring("done", 1, BEAM), F.lit(b"\0"))
        over = state.filter(closed)
        ended = over if ended is None else ended.union(over)
        state = state.filter(~closed)

    def finalists(batches):
        for batch in batches:
            pools = [(x["q"], np.frombuffer(x["pool"], np.int64)[:FINALISTS]) for x in batch.to_pylist()]
            q = np.repeat(np.array([q for q, _ in pools], np.int64), [len(p) for _, p in pools])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([np.empty(0, np.int64), *(p for _, p in pools)]))], names=["q", "node"])

    return (state if ended is None else ended).select("q", "pool").mapInArrow(finalists, "q long, node long")


def nearest(rows: DataFrame, is_query, top: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row that is_query(key column) marks.

    Nearness is the cosine in doubles, ties go to the smaller key, and a row is no candidate of its own.
    Null keys take no part, nor do null or zero vectors, those with a null or non-finite part, or of
    another length than most; of several vectors of one key the smallest counts. Equal vectors are all
    found, as copies. An empty table gives no rows.
    """
    all_rows = usable(rows, key, vector)
    nodes = written(distinct_nodes(all_rows, top + 1))
    count = nodes.count()
    asked = all_rows.filter(is_query(F.col("id"))).join(nodes.select("v", F.col("id").alias("node")), "v").select(F.col("id").alias("query_id"), "v", "node")
    asked = written(asked)
    first = nodes.select(F.size("v").alias("n")).first()
    dim = first["n"] if first else 1
    starts = asked.select(F.col("node").alias("id"), "v").dropDuplicates(["id"])
    found = search(build(nodes, count, dim), starts, count, starts.count(), dim).toDF("start", "to")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    other = nodes.select(F.col("id").alias("to"), F.col("v").alias("w"), "members")
    pairs = found.join(asked, F.col("start") == F.col("node")).select("query_id", "v", "to").join(other, "to")
    pairs = pairs.withColumn("score", dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))))
    hits = pairs.select("query_id", "score", F.explode("members").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    return nearest(rows, lambda key: key % 50 == 0)
