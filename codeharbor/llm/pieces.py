"""SentencePiece encoding that keeps, for every piece, the bytes of the text it came from, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows; beside each
normalised code point stands the byte where its source began. Pieces are then merged by score, and
each is projected through that alignment to a span of the original bytes.

No piece of a vocabulary like this one holds a space mark after another character, so nothing merges
across the start of a word (space marks, then the rest): words are merged alone, and recent ones kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PART_CHARS, STRETCH = 1 << 20, 1 << 16  # of the texts in one output batch, and of what is merged at once
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_START = re.compile(f"[^{MARK}]{MARK}")


class CharacterMap:
    """The compiled map: a double array of the known prefixes, and their replacements one after another."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.starts: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length in bytes and replacement of the longest known prefix of data[at:], or None."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i] or not data[i]:
                break  # a zero byte is in no prefix, it closes one
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end].decode("utf-8")

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def may_start(self, char: str) -> bool:
        """Whether any known prefix begins with the character."""
        if char not in self.starts:
            units, node, known = self.units, self._offset(self.units[0]), True
            for byte in char.encode("utf-8", "surrogatepass"):
                node ^= byte
                unit = units[node] if node < len(units) else 0
                if unit & 0x800000FF != byte or not byte:
                    known = False
                    break
                node ^= self._offset(unit)
            self.starts[char] = known
        return self.starts[char]


def _byte_starts(text: str) -> np.ndarray:
    """The byte where each code point starts, and the length in bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


class Normalizer:
    """normalised text and, per code point of it and at its end, a byte of the original text."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK if spec.escape_whitespaces else " "

    def mapped(self, text: str) -> tuple[str, np.ndarray]:
        """The text with every longest known prefix replaced, unknown characters as they are."""
        starts = _byte_starts(text)
        if not self.map.units:
            return text, starts
        active = [c for c in set(text) if self.map.may_start(c)]
        if not active:
            return text, starts
        data, at_byte = text.encode("utf-8", "surrogatepass"), starts.tolist()
        char_at = dict(zip(at_byte, range(len(at_byte)), strict=True))
        out, places, done = [], [], 0
        for m in re.finditer("[" + "".join(map(re.escape, active)) + "]", text):
            i = m.start()
            if i < done or (hit := self.map.longest(data, at_byte[i])) is None:
                continue
            out += [text[done:i], hit[1]]
            places += [starts[done:i], np.full(len(hit[1]), at_byte[i])]
            done = char_at[at_byte[i] + hit[0]]
        return "".join([*out, text[done:]]), np.concatenate([*places, starts[done:]])

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        made, places = self.mapped(text)
        if self.squeeze:
            points = np.frombuffer(made.encode("utf-32-le", "surrogatepass"), np.uint32)
            spaces = points == 32
            keep = ~spaces
            keep[1:] |= ~spaces[:-1]  # the first space of a run stays, but not at either end
            inner = np.flatnonzero(~spaces)
            if not len(inner):
                return "", places[:1]
            keep[: inner[0]] = keep[inner[-1] + 1 :] = False
            stop = places[inner[-1] + 1]
            made, places = points[keep].tobytes().decode("utf-32-le", "surrogatepass"), np.append(places[:-1][keep], stop)
        if not made:
            return "", places
        made = made.replace(" ", self.space)
        if self.dummy:
            made, places = self.space + made, np.concatenate((places[:1], places))
        if self.squeeze:
            made = made.rstrip(self.space)
        return made, places[: len(made) + 1]


class Pieces:
    """Encoder and decoder of a serialized model of type BPE with byte fallback.

    The library merges the pieces of text that is normalised already: it gets a copy of the model that
    leaves text as it is.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, rules = proto.trainer_spec, proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        inner = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        if spec.model_type != spec.BPE or spec.treat_whitespace_as_suffix or inner or not {NORMAL, UNKNOWN, CONTROL, BYTE}.issuperset(kinds):
            raise ValueError("only BPE models with byte fallback, leading space marks and no own symbols")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if len(byte_ids) != 256 or not rules.escape_whitespaces:
            raise ValueError("the model has no byte fallback or keeps spaces as they are")
        self.normalize = Normalizer(rules)
        self.skip_first = rules.add_dummy_prefix or rules.remove_extra_whitespaces
        self.skip_all = rules.remove_extra_whitespaces
        self.byte_of = np.full(len(kinds), -1, np.int16)
        self.byte_of[[byte_ids[b] for b in range(256)]] = np.arange(256)
        self.width = np.array([1 if p.type == BYTE else len(p.piece) for p in proto.pieces])
        shown = {CONTROL: "", UNKNOWN: spec.unk_surface}
        self.shown = [shown.get(p.type, p.piece).replace(MARK, " ") for p in proto.pieces]
        self.marked = [p.type == NORMAL and p.piece.startswith(MARK) for p in proto.pieces]
        rules.Clear()
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def _merged(self, made: str) -> np.ndarray:
        """The ids of a normalised text, merged in stretches that begin at a mark."""
        out, start = [np.empty(0, np.int32)], 0
        while start < len(made):
            cut = _START.search(made, start + STRETCH)
            end = cut.end() - 1 if cut else len(made)
            out.append(np.array(self.merger.encode(made[start:end]), np.int32))
            start = end
        return np.concatenate(out)

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Code points of each piece; of a character's bytes the last one counts."""
        widths, byte = self.width[ids], self.byte_of[ids]
        if (byte >= 0).any():
            follows = np.append((byte[1:] & 0xC0 == 0x80) & (byte[1:] >= 0), False)
            widths = np.where((byte >= 0) & follows, 0, widths)
        return widths

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and per piece the first byte of its span and the one after it. Null is empty."""
        made, places = self.normalize(text or "")
        ids = self._merged(made)
        edges = np.concatenate(([0], np.cumsum(self._widths(ids))))
        return ids, places[edges[:-1]], places[edges[1:]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; a byte that is part of no character becomes U+FFFD."""
        if not len(ids):
            return ""
        if (self.byte_of[ids] < 0).all():
            out = list(map(self.shown.__getitem__, ids.tolist()))
        else:
            out, run = [], bytearray()
            for i, b in zip(ids.tolist(), self.byte_of[ids].tolist(), strict=True):
                if b >= 0:
                    run.append(b)
                    out.append("")
                    continue
                if run:
                    out[-1] = _characters(run)
                    run = bytearray()
                out.append(self.shown[i])
            if run:
                out[-1] = _characters(run)
        if self.skip_first:
            for at, i in enumerate(ids.tolist()):
                if out[at] and self.marked[i]:
                    out[at] = out[at][1:]
                    if not self.skip_all:
                        break
                if out[at] or self.byte_of[i] >= 0:
                    break
        return "".join(out)


def _characters(run: bytearray) -> str:
    """Bytes as text; each byte that begins no whole character is one U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def coder(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str | None = None) -> bytes:
    """The content of a model file on the driver; a public model unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(kind.to_pandas_dtype()), kind))


def _parts(sizes: list[int]):
    """(start, stop) of runs of rows of about PART_CHARS together."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > PART_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """One row per document: key, n_bytes, ids, begins, ends; with `decoded` also the text of the ids.

    Piece i stands for bytes begins[i] to ends[i] of the text in UTF-8: spans ascend, do not overlap
    and cover the text, but for spaces that normalisation takes away. Of a character given as bytes the
    last piece has the span. A null or empty text has no ids; repeated rows and keys stay as they are.
    Texts stay whole; a task holds the pieces of PART_CHARS of text, or of one text.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        pieces = coder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts([len(t or "") for t in texts]):
                ids, begins, ends = zip(*map(pieces.encode, texts[a:b]), strict=True)
                columns = [pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.int64()), _lists(ids, pa.int32()), _lists(begins, pa.int64()), _lists(ends, pa.int64())]
                names = ["k", "n_bytes", "ids", "begins", "ends"]
                if decoded:
                    columns.append(pa.array([pieces.decode(i) for i in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names)

    made = f"k {kind}, n_bytes long, ids array<int>, begins array<long>, ends array<long>" + ", decoded string" * decoded
    return rows.mapInArrow(run, made).withColumnRenamed("k", key)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row: key, decoded. Null and empty lists are the empty text."""
    chosen = rows.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("i"))
    kind = chosen.schema["k"].dataType.simpleString()

    def run(batches):
        pieces = coder(model)
        for batch in batches:
            texts = [pieces.decode(np.array(i or [], np.int32)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "decoded"])

    return chosen.mapInArrow(run, f"k {kind}, decoded string").withColumnRenamed("k", key)


def report(docs: DataFrame, model: bytes) -> DataFrame:
    """Digests of ids and of the decoded text; covered_bytes is how many of the n_bytes the spans hold."""
    made = encode(docs, model, decoded=True)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"), "n_bytes", covered.alias("covered_bytes"),
    )
