"""Language-model scores, packing, and the pipeline."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from codeharbor.llm import common, decontaminate, lm_mixing, packing, pii, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def documents():
    return duckdb.query(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


# ---- language model ---------------------------------------------------------------------------------------


def plain_base(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    def part(k):
        return zlib.crc32(("" if k is None else str(k)).encode()) % 7

    seen = Counter(w for k, t in rows if part(k) != 2 for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return [(k, part(k) == 2, len(ws), sum(seen[w] > 0 for w in ws), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)) for k, t in rows for ws in [tokens(t)]]


def check_base(spark, frame, rows):
    def order(r):
        return (repr(r[0]), *r[1:4], round(r[5], 6))

    got = sorted((tuple(r)[:6] for r in lm_mixing.score(frame).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=order)
    want = sorted(plain_base(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 100_000)
    check_base(spark, spark.read.parquet(f"{SF}/documents.parquet"), documents())


def test_scores_of_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Word word WORD"), (4, "Word word WORD"), (None, "ä b c"), (5, "long " * 60_000), (6, "x" * 300_000), (16, "unseen")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS part", "3 AS block")
    check_base(spark, frame, rows)
    scores = {r["doc_id"]: r["score"] for r in lm_mixing.score(frame).collect()}
    assert scores[1] == scores[2] == scores[3] and all(s < 0 for s in scores.values())
    assert lm_mixing.score(frame.limit(0)).count() == 0


VOCABULARY = {b"abra": 5, b"abracadabra": 2, b"cab": 1, b"a": 9, b"": 6, b"dab": 0, b"zz": 0}


def small_model(monkeypatch):
    monkeypatch.setattr(lm_mixing, "SLOT_BITS", (22,) * 4)
    monkeypatch.setattr(lm_mixing, "LEAST_BITS", 22)  # so few bits that no two share a slot
    return lm_mixing.Model(sorted(VOCABULARY), np.array([VOCABULARY[w] for w in sorted(VOCABULARY)]))


def plain_bits(code, word):
    """(contexts, step, bit) of every coded bit of a word."""
    out = []
    for i, symbol in enumerate([*word, 256]):
        contexts = [(k, word[max(0, i - k) : i], min(i, k)) for k in (1, 2, 3)] + [("word", word[:i])]
        out += [(contexts, s, int(code.bit[s])) for s in range(code.start[symbol], code.start[symbol] + code.length[symbol])]
    return out


def plain_log10(model, word):
    counts = Counter()
    for w, c in VOCABULARY.items():
        for contexts, s, bit in plain_bits(model.code, w):
            for x in contexts:
                counts[x, int(model.code.node[s]), bit] += c
    total = 0.0
    for contexts, s, bit in plain_bits(model.code, word):
        node = int(model.code.node[s])
        pairs = [[counts[x, node, v] for v in (0, 1)] for x in contexts]
        odds = [max(-8, min(8, math.log((n1 + 0.1) / (n0 + 0.1)))) for n0, n1 in pairs]
        high, low = (sum(sum(pairs[k]) > edge for edge in (0.5, 1.5, 3.5, 7.5, 31.5, 127.5, 1023.5)) for k in (2, 3))
        mixed = max(-12, min(12, sum(float(model.weights[k, high * 8 + low]) * x for k, x in enumerate(odds))))
        place = int((max(-8, min(8, mixed)) + 8.25) * 2)
        final = (mixed + float(model.refine[node * 33 + place])) / 2
        total -= math.log1p(math.exp(-final if bit else final))
    return total / math.log(10)


def test_words_cost_what_a_plain_model_says(monkeypatch):
    model = small_model(monkeypatch)
    words = [*VOCABULARY, b"abr", b"unseen \xff", b"q" * 300]
    assert model.log10(words) == pytest.approx([plain_log10(model, w) for w in words], rel=1e-4)


def test_probabilities_of_all_words_sum_to_one(monkeypatch):
    model = small_model(monkeypatch)
    p = dict(zip(words := [b"", *(bytes([a]) for a in range(256))], (10 ** model.log10(words)).tolist(), strict=True))
    longer = 10 ** model.log10([b"a" + bytes([x]) for x in range(256)])
    assert 0.5 < sum(p.values()) < 1 and sum(p.values()) + longer.sum() < 1
    assert p[b"a"] > p[b"z"] and sum(2.0 ** -int(n) for n in model.code.length) == pytest.approx(1)


def test_long_words_agree_with_slices(monkeypatch):
    words = sorted({b"the", b"cat", b"x" * 5000, b"abc" * 700})
    whole = lm_mixing.Model(words, np.array([1, 2, 3, 4]))
    costs = whole.log10(words)
    monkeypatch.setattr(lm_mixing, "SLICE", 500)
    monkeypatch.setattr(lm_mixing, "CHUNK", 900)
    assert whole.log10(words) == pytest.approx(costs, rel=1e-5)


def test_weights_are_learnt_from_all_occurrences():
    words = sorted({b"w%d" % (i * 7919 % 5000) for i in range(4000)})
    model = lm_mixing.Model(words, np.arange(len(words)) % 3)
    assert np.abs(model.weights - 0.3).max() > 0.05 and np.isfinite(model.weights).all()
    known, unknown = model.log10(words)[np.arange(len(words)) % 3 > 0], model.log10([b"q%d" % i for i in range(500)])
    assert known.mean() > unknown.mean() + 0.5


def test_training_helps(spark):
    rows = [r for r in lm_mixing.score(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in rows) / len(rows) < 4


def test_texts_are_read_once_and_shuffles_go(spark):
    before = spark.conf.get(lm_mixing.CLEANUP)
    read = lm_mixing.score(spark.read.parquet(f"{SF}/documents.parquet")).inputFiles()
    assert read and not any("documents.parquet" in path for path in read)
    assert spark.conf.get(lm_mixing.CLEANUP) == before


def test_short_numbers_come_back():
    values = np.array([0, 1, 1 << 23, (1 << 24) - 1], np.uint64)
    assert lm_mixing._long(lm_mixing._short(values, 3), 3).tolist() == values.tolist()


# ---- packing ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return packing.vocabulary_text()


def check_pieces(rows, ids_of, order=None):
    """Pieces cover each document once, sequences are gapless and short, and ids are right."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for key, pieces in docs.items():
        want, at = ids_of[key], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    assert set(docs) == set(ids_of)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SIZE
        padding += packing.SIZE - at
    return padding, len(sequences)


def test_packing_of_documents(spark, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in documents()}
    padding, n = check_pieces(packing.report(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary).collect(), ids)
    assert padding <= 2048 + 0.02 * 2048 * n


def test_packing_edge_cases(spark, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    texts = [None, "", " ", "a  b \n\n c\t", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>c.  d", "no end " * 3000, "S. " * 4000, "x" * 9000, "don't 's  y \x1cz", "日本語。テキスト" * 50, " lead", "trail "]
    rows = [*enumerate(texts)]
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS k")
    check_pieces(packing.report(frame, vocabulary).collect(), ids)
    monkeypatch.setattr(packing, "STRETCH", 3000)
    check_pieces(packing.report(frame, vocabulary).collect(), ids)
    twice = packing.report(frame.union(frame), vocabulary)
    assert twice.agg({"length": "sum"}).first()[0] == 2 * sum(map(len, ids.values()))
    assert packing.report(frame.limit(0), vocabulary).count() == 0
    assert packing.report(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), vocabulary).count() == 1


def test_windows_are_the_cheapest():
    draw = np.random.default_rng(3)
    for _ in range(200):
        ends = np.cumsum(draw.integers(1, 9, draw.integers(1, 14)))
        penalties = draw.integers(0, 6, len(ends))
        best = {0: 0}
        for x, p in zip(ends.tolist(), penalties.tolist(), strict=True):
            best[x] = min(c + 12 - (x - a) for a, c in best.items() if 0 < x - a <= 12) + p
        price = dict(zip(ends.tolist(), penalties.tolist(), strict=True))
        cuts = packing.windows(ends, penalties, 12)
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == ends[-1] and sizes.max() <= 12
        assert sum(12 - s for s in sizes) + sum(price[c] for c in cuts) == best[ends[-1]]


# ---- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for (name, stage), _ in zip(corpus_pipeline.STAGES, range(4), strict=False):
        made = common.written(stage(spark, docs, SF))
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"]: r.asDict() for r in made.collect()}
        assert set(kept) <= set(rows)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.report(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
            assert set(kept) == set(rows) - bad
        elif name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert set(kept) == set(groups.values())
        elif name == "decontamination":
            hits = {r["doc_id"] for r in decontaminate.report(made, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["contaminated"]}
            assert not hits
        else:
            want = {r["doc_id"]: r["text"] for r in pii.replace(docs, queries.SECRET).collect()}
            assert {k: r["text"] for k, r in kept.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for k, r in kept.items() if r["text"] != rows[k]["text"])
        docs, rows = made, kept
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == set(rows)


def test_pipeline_of_no_documents_and_clashing_names(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr(
        "*", "'a' AS _score", "'b' AS _spans", "'c' AS _n_words", "'d' AS _item_ids", "'e' AS _subs", "'f' AS _k", "'g' AS _m", "'h' AS _n_entities", "'i' AS _name")
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = common.written(stage(spark, docs, SF))
        assert made.columns == docs.columns and made.count() > 0
        assert {tuple(r)[5:] for r in made.collect()} == {tuple("abcdefghi")}
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() > 0


def test_pipeline_run_and_registration(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_words_cost_what_stands_before_them(spark, monkeypatch):
    parts = {p: [k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 == p] for p in (1, 2)}
    texts = ["the red fox runs over green hills today", "a cold wind blows along empty streets tonight"] * 40
    rows = [*zip(parts[1], texts, strict=False), (parts[2][0], texts[0]), (parts[2][1], "today hills green over runs fox red the"), (parts[2][2], "a red fox blows along green hills tonight")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lm_mixing.score(frame).collect()}
    same, turned, mixed = (scores[k] for k in parts[2][:3])
    assert turned + 3 < mixed < same - 1 and scores[parts[1][0]] == pytest.approx(same, abs=1e-4)
    monkeypatch.setattr(lm_mixing, "SPREAD", 10)  # the words after each are dealt to several shards
    monkeypatch.setattr(common, "BLOCK_BYTES", 1000)
    scores = {r["doc_id"]: r["score"] for r in lm_mixing.score(frame).collect()}
    assert scores[parts[2][1]] + 3 < scores[parts[2][0]] < 0


def test_following_words_and_the_escape_sum_to_one():
    last, word = np.repeat(np.arange(6, dtype=np.uint32), 5), np.tile(np.arange(5, dtype=np.uint64), 6)
    chain = lm_mixing.Chain(last, last, word, (last * 3 + word * 5) % 4)
    costs, escaped = chain.follow(np.full(6, 2, np.uint32), np.full(6, 2, np.uint32), np.array([0, 1, 2, 3, 4, 99], np.uint64))
    assert escaped.tolist() == [False] * 5 + [True] and 0.5 < (10**costs).sum() <= 1


def small_chain():
    rng = np.random.default_rng(3)
    last, earlier, word = (rng.zipf(1.5, 3000).astype(np.uint64) % np.uint64(60) for _ in range(3))
    return lm_mixing.Chain(last, earlier, word, rng.integers(0, 3, 3000))


def test_numbers_of_a_chain_are_plain_counts():
    chain = small_chain()
    last, earlier, symbol, counts = (x.tolist() for x in chain.threes)
    paths = [chain.code.bit[a : a + n].tolist() for a, n in zip(chain.code.start.tolist(), chain.code.length.tolist(), strict=True)]
    plain = Counter()
    for x, y, s, c in zip(last, earlier, symbol, counts, strict=True):
        for d in range(len(paths[s]) + 1):
            for context in (("earlier", y), ("last", x), ("both", x, y)):
                plain[context, tuple(paths[s][:d])] += c
    for i, (x, y, s) in enumerate(zip(last, earlier, symbol, strict=True)):
        for context, (start, numbers) in zip((("earlier", y), ("last", x), ("both", x, y)), chain.items.seen, strict=True):
            at = start[chain.place[i]]
            assert numbers[at : at + len(paths[s]) + 1].tolist() == [plain[context, tuple(paths[s][:d])] for d in range(len(paths[s]) + 1)]


def test_what_a_chain_has_learnt_is_what_it_says():
    chain = small_chain()
    n = chain.given
    last, earlier, symbol = (x[:n] for x in chain.threes[:3])
    known = symbol < len(chain.words)
    costs, escaped = chain.learnt()
    again, none = chain.follow(last[known], earlier[known], chain.words[symbol[known]])
    assert again == pytest.approx(costs[known], rel=1e-6) and not none.any() and (escaped == ~known).all()


def test_codes_are_the_shortest():
    counts = np.random.default_rng(1).zipf(1.3, 700) % 10000
    nodes, total = sorted((counts + 1).tolist()), 0
    while len(nodes) > 1:
        total += nodes[0] + nodes[1]
        nodes = sorted([nodes[0] + nodes[1], *nodes[2:]])
    code = lm_mixing.prefix_code(counts)
    assert (code.length * (counts + 1)).sum() == total and (2.0**-code.length).sum() == pytest.approx(1)


def test_tokens_are_those_of_the_plain_split():
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u2003", "a", "B", "\u00c4", "\x00", "Z"]
    rng = np.random.default_rng(2)
    texts = [None, "", " \n", "x", *("".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(500)), None]
    tokens, (n, size), words = lm_mixing._tokens(pa.array(texts))
    ends = np.cumsum(n)
    for t, low, high, s in zip(texts, ends - n, ends, size, strict=True):
        plain = lm_mixing.words_of(t)
        assert [words[i] for i in tokens[low:high]] == [*plain, b""] and s == max(1, len(b" ".join(plain)))


def test_threes_travel_in_few_bytes():
    rows = documents()
    table = pa.table({"block": pa.array([0] * len(rows)), "k": pa.array([k for k, _ in rows]), "t": pa.array([t for _, t in rows]), "part": pa.array([1] * len(rows), pa.int32())})
    listed = lm_mixing._list_words(2)(table)
    block = listed.filter(listed["shard"].is_null()).select(["block", "tokens", "hashes", "sizes"])
    sent = pa.Table.from_batches(lm_mixing._list_threes(2, lm_mixing.SPREAD, np.zeros((2, 0), np.uint64))(block.to_batches()))
    words = [w for _, t in rows for w in (b"", b"", *(t or "").encode().lower().split(), b"")]
    threes = {x for x in zip(words, words[1:], words[2:], strict=False) if x[1:] != (b"", b"")}
    assert sum(sent[c].nbytes for c in ("last", "earlier", "word", "counts")) < 8.8 * len(threes)
