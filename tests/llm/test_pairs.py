"""SimHash links, repeated strings and nearest neighbours against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

from codeharbor.llm import ann, common, simhash, suffix_dedup
from codeharbor.llm.suffix_array import permuted_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.query(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints):
    """{key: (fingerprint, smallest key of its component)}"""
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (f"{prints[k]:016x}", find(k)) for k in keys}


def test_simhash_matches_brute_force(spark):
    docs = {r[0]: r[1] for r in table("documents")}
    want = plain_components({k: plain_fingerprint(t) for k, t in docs.items()})
    got = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_every_pair_within_three_bits_is_linked(spark):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    prints = sorted({c ^ sum(1 << b for b in draw.sample(range(64), k)) for c in centres for k in (0, 0, 1, 2, 3, 4, 5) for _ in range(4)})
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(frame).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if bin(a ^ b).count("1") <= 3}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_simhash_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One Word", None), (5, "one word", "x"), (5, "one word", "x"), (None, "one word", "x"), (6, long, "x"), (7, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").withColumnRenamed("component", "fp")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()))
    zero, word = "0" * 16, f"{plain_fingerprint('one word'):016x}"
    assert [x[:2] + x[3:] for x in got] == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 5, 4), (False, 5, 4), (False, 6, 6), (False, 7, 6), (True, 0, 4)]
    assert [x[2] for x in got[:6]] == [zero] * 3 + [word] * 3
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 4, 6]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_the_first_of_each_component(spark):
    docs = {r[0]: r[1] for r in table("documents")}
    want = {low for _, low in plain_components({k: plain_fingerprint(t) for k, t in docs.items()}).values()}
    frame = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS _row", "'mine' AS _held", "3 AS fp")
    got = simhash.keep_one(frame).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want) and all(r["_held"] == "mine" and r["text"] == docs[r["doc_id"]] for r in got)
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_one_row_of_each_group_stays_when_a_key_repeats(spark):
    texts = [f"{w} is a text of its own about {w} and nothing else than {w}" for w in ("tea", "rain", "iron", "wool")]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (2, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert got == sorted([(5, texts[0]), (2, texts[1]), (7, texts[2]), (7, texts[3])])


# ---- suffix arrays ------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_suffix_array_matches_sorting(letters):
    draw = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, *draw.integers(4, 90, 60)]:
        text = draw.integers(0, letters, n).astype(np.uint8)
        raw = text.tobytes()
        want = sorted(range(n), key=lambda i: raw[i:])
        assert suffix_array(text).tolist() == want
        if n:
            shared = permuted_prefixes(text, np.array(want), 9)
            for a, b in zip(want, want[1:], strict=False):
                k = next((k for k in range(9) if max(a, b) + k >= n or raw[a + k] != raw[b + k]), 9)
                assert shared[b] == k
            assert shared[want[0]] == 0


def plain_strip(rows, length=50):
    first = {}
    for key, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], key)
    out = []
    for key, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            owner = first[t[i : i + length]]
            if owner != key and (key is None or owner < key):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def stripped(docs, **options):
    return sorted((tuple(r) for r in suffix_dedup.strip_repeats(docs, with_text=False, **options).collect()), key=repr)


@pytest.mark.parametrize(("block", "hot"), [(None, 2000), (60_000, 2)])
def test_repeats_match_brute_force(spark, monkeypatch, block, hot):
    if block:
        monkeypatch.setattr(common, "BLOCK_BYTES", block)
    rows = [(r[0], (r[1] or "").encode()) for r in table("documents")]
    assert stripped(spark.read.parquet(f"{SF}/documents.parquet"), hot=hot) == plain_strip(rows)


def test_repeats_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 3000)
    passage = "the quick brown fox jumps over the lazy dog while it rains all day long in the old town "
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 400, passage, "x" + passage, passage * 30, "é" * 60, "zé" * 40 + passage[:50], passage[:49]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a" * 70), (3, "a" * 70), (None, passage), (None, passage), (50, "ab" * 4000), (51, "ab" * 4000 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS shard", "1 AS block")
    for hot in (1, 3, 2000):
        assert stripped(docs, hot=hot) == plain_strip([(k, (t or "").encode()) for k, t in rows])
    assert stripped(docs.limit(0)) == []


# ---- neighbours -----------------------------------------------------------------------------------------


def plain_nearest(rows, top=5):
    vecs = {k: np.array(v, float) for k, v in rows}
    out = {}
    for q, a in vecs.items():
        if q % 50 == 0:
            score = {k: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for k, b in vecs.items() if k != q}
            out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:top]
    return out


def test_recall_of_nearest(spark):
    want = plain_nearest([(r[0], r[1]) for r in table("embeddings")])
    found = {}
    for r in ann.report(spark.read.parquet(f"{SF}/embeddings.parquet")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r[1] for r in rows} & {k for k, _ in want[q]})
        for _, k, score in rows:
            assert score == pytest.approx(dict(want[q]).get(k, score), abs=1e-12)
    assert hits / (5 * len(want)) >= 0.9


def test_nearest_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.1]), (7, [0.0, 1.0]), (9, [-1.0, 0.0]), (100, [0.0, -3.0])]
    bad = [(1, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (11, []), (150, None)]
    frame = spark.createDataFrame(good + bad + good[:1], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS q")
    got = {}
    for r in ann.report(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [k for k, _ in rows] for q, rows in plain_nearest(good).items()}
    assert ann.report(frame.limit(0)).count() == 0
    assert ann.report(frame.filter("vec_id = 0")).count() == 0


def test_recall_over_many_chunks_and_near_copies(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((4, 32))
    near = np.repeat(centres, 1000, axis=0) + 0.01 * draw.standard_normal((4000, 32))  # cosine about 0.9999
    vecs = np.concatenate((near, draw.standard_normal((3000, 32))))[draw.permutation(7000)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    found = {}
    for r in ann.report(frame).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, ids in found.items():
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(ids & set(np.argsort(-sims)[:5].tolist()))
    assert len(found) == 140
    assert hits / (5 * len(found)) >= 0.9
