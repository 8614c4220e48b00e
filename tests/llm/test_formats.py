"""Piece encoding, fill-in-the-middle and the Merkle manifest against the library and plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from codeharbor.llm import fim, merkle, pieces

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents():
    return duckdb.query(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def odd_texts(n=600, alphabet=" \n\taé1漢▁😀<s>\x00thein., �"):
    draw = random.Random(1)
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 40))) for _ in range(n)]
    return [*made, "", " ", "  ", " a", "the " * 500, " " * 1000, "x" * 5000, "ab" * 4000, "1234" * 500, "a  b " * 30_000]


# ---- pieces -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes()


def test_pieces_and_spans_are_those_of_the_library(model):
    ours, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in [*odd_texts(), *(t for _, t in documents())]:
        ids, begins, ends = ours.encode(t)
        want = library.encode(t)
        assert ids.tolist() == want and ours.decode(ids) == library.decode(want)
        if len(t) < 2000:
            assert [*zip(begins.tolist(), ends.tolist(), strict=True)] == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_decoding_of_any_ids(model):
    ours, library, draw = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(2)
    for _ in range(500):
        ids = [draw.choice([0, 1, 2, *range(3, 259), *range(259, 400)]) for _ in range(draw.randrange(0, 9))]
        assert ours.decode(np.array(ids, np.int32)) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
def test_longest_prefix_normalisation_with_alignment(rule):
    texts = [*(t for t in odd_texts(150) if len(t) < 100), "ﬁ ①ｱ  x ", "Ａｂ́é ｶﾞ", "ÅΩ ", "½ TEST ẞ", "​ zero‍", " ▁ ", "▁▁"]
    for k in range(8):
        flags = {"add_dummy_prefix": bool(k & 1), "remove_extra_whitespaces": bool(k & 2), "escape_whitespaces": bool(k & 4)}
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
        ours = pieces.Normalizer(spec.normalizer_spec)
        for t in texts:
            made, places = ours(t)
            want, offsets = library.normalize(t, with_offsets=True)
            at = pieces._byte_starts(t).tolist()
            assert made == want and [at.index(x) for x in places.tolist()] == list(offsets)


def test_long_texts_are_merged_in_stretches(model, monkeypatch):
    whole = [pieces.Pieces(model).encode(t)[0].tolist() for t in odd_texts(50)]
    monkeypatch.setattr(pieces, "STRETCH", 5)
    assert [pieces.Pieces(model).encode(t)[0].tolist() for t in odd_texts(50)] == whole


def test_encoding_as_rows(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [*enumerate(odd_texts(30)), (7, "twice"), (7, "twice"), (None, "no key"), (900, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS k", "3 AS decoded", "4 AS n_bytes")
    got = sorted((tuple(r)[:4] for r in pieces.report(frame, model).collect()), key=repr)
    want = []
    for k, t in rows:
        ids = library.encode(t or "")
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    assert all(r["covered_bytes"] == r["n_bytes"] for r in pieces.report(frame, model).collect())
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(frame, model), model).collect()}
    assert back[900] == "" and back[None] == "no key"
    assert pieces.report(frame.limit(0), model).count() == 0


# ---- fill in the middle -------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize(("unit", "pattern"), [("token", TOKEN.pattern), ("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")])
def test_cuts_are_at_unit_ends(monkeypatch, unit, pattern):
    texts, draw = odd_texts(300), random.Random(3)
    draws = [(draw.randrange(1 << 32), draw.randrange(1 << 32)) for _ in texts]
    for stretch in (50, 1 << 21):
        monkeypatch.setattr(fim, "STRETCH", stretch)
        for t, (x, y), (n, a, b) in zip(texts, draws, fim.cuts(texts, draws, unit), strict=True):
            units = re.findall(pattern, t)
            low, high = sorted((x % (n + 1), y % (n + 1)))
            assert n == len(units) and a == len("".join(units[:low])) and b == len("".join(units[:high]))


def test_ranks_and_selects():
    text = np.random.default_rng(1).integers(0, 8, 500).astype(np.uint8)
    matrix = fim.WaveletMatrix(text)
    for s in range(8):
        places = np.flatnonzero(text == s)
        assert (matrix.select(s, np.arange(len(places))) == places).all()
        assert (matrix.rank(s, np.arange(501)) == np.concatenate(([0], np.cumsum(text == s)))).all()


def plain_fim(key, text):
    text = text or ""
    units, h = TOKEN.findall(text), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    made = f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"
    return key, n, form, len(x), len(y), sha(made), sha(text)


def test_fim_rows(spark):
    rows = [*enumerate(t.replace("\x00", "") for t in odd_texts(200)), *[(1000 + i, "a <P> b" if i % 5 else "x <" * i + "S><") for i in range(60)]]
    rows += [(None, "no key here"), (2000, None), (3, "twice"), (3, "twice")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS form", "2 AS k", "3 AS t", "4 AS h")
    got = sorted((tuple(r) for r in fim.report(frame).collect()), key=repr)
    assert got == sorted((plain_fim(*r) for r in rows), key=repr)
    assert fim.report(frame.limit(0)).count() == 0
    lines = fim.transform(frame, unit="line", rate=100, spm_rate=0).filter("form <> 'plain'").collect()
    assert lines and {r["form"] for r in lines} == {"psm"}


# ---- Merkle manifest -----------------------------------------------------------------------------------------


def plain_levels(digests):
    made = [digests]
    while len(made[-1]) > 1:
        made.append([sha("".join(made[-1][i : i + 16])) for i in range(0, len(made[-1]), 16)])
    return made


def plain_siblings(made, at):
    out = []
    for level in made[:-1]:
        run = at - at % 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def plain_manifest(rows):
    """rows(doc_id, source, lang, n_chars, text) -> the contract's rows."""

    def digest(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def lowered(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), None) for g in order}
    trees = {g: (members, plain_levels([m[2] for m in members])) for g, (members, _) in trees.items()}
    top = plain_levels([trees[g][1][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        members, made = trees[g]
        for i, (_, _, d, r) in enumerate(members):
            path = plain_siblings(made, i) + plain_siblings(top, j)
            hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
            f = digest((*r[:4], lowered(r[4]))) if hit else d
            for left, right in path:
                f = sha("".join([*left, f, *right]))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((r[0], d, made[-1][0], top[-1][0], proof, f, f == top[-1][0]))
    return sorted(out, key=repr)


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_edge_cases(spark):
    rows = [(i, f"s{i % 19}", None if i % 7 == 0 else "en", i, f"Text {i} É") for i in range(700)]
    rows += [(i, "hot", "en", None, f"T{i}") for i in range(600)]
    rows += [(5, "hot", "en", None, "again"), (5, "hot", "en", None, "again"), (None, None, None, None, None), (None, "", "", 0, ""), (9, None, "x", 1, "X" * 70_000), (11, "lone", "x", 1, None)]
    frame = spark.createDataFrame(rows, KIND)
    clash = frame.selectExpr("*", "1 AS tree", "2 AS at", "3 AS digest", "4 AS size", "5 AS path", "6 AS k")
    assert sorted((tuple(r) for r in merkle.report(clash).collect()), key=repr) == plain_manifest(rows)
    assert merkle.report(frame.limit(0)).count() == 0
    one = merkle.report(frame.filter("source = 'lone'")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")


def test_manifest_over_three_rounds(spark):
    frame = spark.range(66_000).selectExpr("id AS doc_id", "if(id < 65800, 'big', concat('s', id)) AS source", "'en' AS lang", "id AS n_chars", "concat('Doc ', id) AS text")
    rows = [tuple(r) for r in frame.collect()]
    assert sorted((tuple(r) for r in merkle.report(frame).collect()), key=repr) == plain_manifest(rows)


def test_versions_share_untouched_nodes(spark):
    rows = [(i, "a", "en", i, f"Doc {i}") for i in range(300)]
    made = merkle.prove(merkle.leaves(spark.createDataFrame(rows, KIND))).collect()
    base = next(r["versions"] for r in made if r["folded_root"] == r["root"])
    assert len(base) == 3 and base[-1] == made[0]["root"]
    changed = [r for r in made if r["folded_root"] != r["root"]]
    assert changed and all(len(r["versions"]) == 3 and r["versions"][-1] == r["folded_root"] for r in changed)
    assert len({r["folded_root"] for r in changed}) == len(changed)
