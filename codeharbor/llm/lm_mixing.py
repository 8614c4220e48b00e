"""Language-model scores by logistic context mixing of bit predictors.

A text is its words, A-Z lower-cased, and an end; a word is its bytes and an end sign, and the end of the
text is the word without bytes. Symbols are coded by a prefix code, and every bit of the code is
predicted. A predictor counts, per hash of one kind of context and place in the code, how often either bit
followed: in a hashed table, or for threes of words over sorted contexts. The log odds of the predictors are mixed with weights that a gate picks by how
much two of the contexts have been seen. The weights are learnt online, batch of bits after batch, over
every training occurrence, each predicted from the counts of all the others; a last table refines the
mixed probability adaptively, by place and strength. Total bits give the probability.

Two such models work together. One predicts which word follows the two before it: each different three of
words in a row goes with its training occurrences to the shard of its first two, whose code is that of the
words seen there and an escape; the contexts are none, either word before, and both. What follows a
frequent word is dealt to more shards. A word that its shard has not seen costs the escape and is spelled
by the other model, whose symbols are bytes and whose contexts are the last 1 to 3 bytes of the word, or
all of it so far: words are counted and spelled in shards of the vocabulary by their first bytes, and an
unseen word's probability is that of its shard, by the tokens there, times that inside the shard.

Each shard has code, tables, weights and refinement of its own, and their number grows with the corpus.
Blocks of documents number their tokens once and ask the shards for counts and costs; no model is broadcast
or sampled. Only the list of words that many tokens are goes to all tasks, as threes are dealt by it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import block_count, fold, written

FOLDS, HELD_OUT = 7, 2
ORDERS, INPUTS = (1, 2, 3), 4  # bytes of context, and the word so far
LONG = (2, 3)  # the contexts whose sightings pick the weights
BLOCK_SHARE, PREFIX, SHARD_SHARE = 4, 3, 2  # parts of a usual block of text; bytes that deal a word to its shard; shards per part
SLOT_BITS, LEAST_BITS = (18, 20, 22, 22), 12  # most slots of each table, which a shard of usual size needs, and least
KEPT = 1 << 22  # bits of words up to which a shard's inputs are kept from pass to pass
FRONT, NEAR = 14, 30  # bits of a context's hash: of its last word, which sorts it, and of all of it
STEPS, CHAIN_RATE, PLACES = 1 << 15, 0.1, 1 << 10  # coded bits learnt from at a time; the nodes that have a refinement of their own
SPREAD = 1 << 17  # occurrences from which the words after one word are dealt to several shards
CHUNK, SLICE = 1 << 16, 1 << 14  # symbols worked on at a time
BATCH, RATE, EPOCHS, LEAST = 4096, 0.05, 2, 0.02
END, BUCKETS, SPAN = 256, 33, 8.0
WORD_STEP = 0x9E3779B97F4A7C15
SEEN = np.array([0.5, 1.5, 3.5, 7.5, 31.5, 127.5, 1023.5])
STRATUM = np.searchsorted(SEEN, np.arange(1025))  # of each number of sightings; more count as the last
STRATA, GATED = STRATUM.astype(np.uint8), (0, 8, 1)  # the part in the gate of the word before the last, the last, and both


class Code(NamedTuple):
    """The prefix code: per symbol where its path starts and its length; per step the node, its hash and the bit."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    salt: np.ndarray
    bit: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    """Huffman's code over the symbols; each has a path, seen or not."""
    n = len(counts)
    weight = np.asarray(counts).astype(np.int64) + 1
    up, side = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.uint8)
    at, fresh = np.argsort(weight, kind="stable"), n
    weight = weight[at]
    while len(at) > 1:  # what weighs no more than the two least together is paired before any new node
        m = int(np.searchsorted(weight, weight[0] + weight[1], "right")) & ~1
        made, total = np.arange(fresh, fresh + m // 2), weight[0:m:2] + weight[1:m:2]
        up[at[0:m:2]] = up[at[1:m:2]] = made
        side[at[1:m:2]] = 1
        where = np.searchsorted(weight[m:], total, "right")
        weight, at, fresh = np.insert(weight[m:], where, total), np.insert(at[m:], where, made), fresh + m // 2
    length, at, above = np.zeros(n, np.int64), np.arange(n), up[:n]
    while n > 1 and len(at):
        length[at] += 1
        going = up[above] >= 0
        at, above = at[going], up[above[going]]
    ends = np.cumsum(length)
    node, bit = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint8)
    at, where = np.arange(n), ends - 1
    while len(at) and n > 1:
        node[where], bit[where] = up[at] - n, side[at]
        at, where = up[at], where - 1
        going = up[at] >= 0
        at, where = at[going], where[going]
    salt = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return Code(ends - length, length, node, salt, bit)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, each closed by END, and where each word starts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(int(sizes.sum()) + len(words), END, np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(out), bool)
    body[starts + sizes] = False
    out[body] = np.frombuffer(b"".join(words), np.uint8)
    return out, starts


def _contexts(symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A hash per symbol and kind of context; contexts stay in their word."""
    n = len(symbols)
    depth = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
    values = symbols.astype(np.uint64) + np.uint64(1)
    out, code = [], np.zeros(n, np.uint64)
    for k in range(1, max(ORDERS) + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[k:] = values[: n - k]
        shifted[depth < k] = 0
        code = code | (shifted << np.uint64(9 * (k - 1)))
        if k in ORDERS:
            out.append(code)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(0, int(depth.max(initial=0))), WORD_STEP, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[depth])))
    word = total[:-1] - total[np.arange(n) - depth]  # of the symbols of the word before each place
    return [*out, word ^ (depth.astype(np.uint64) << np.uint64(48))]


class Bits(NamedTuple):
    """The coded bits of some symbols: slots per table, the step of the code, the bit, and the word of each."""

    slots: list[np.ndarray]
    step: np.ndarray
    bit: np.ndarray
    owner: np.ndarray


def _coded(words: list[bytes], code: Code, sizes: list[int]):
    """Bits of the words in slices of about SLICE symbols; a long word takes several."""
    group, size, first = [], 0, 0
    for i, w in enumerate([*words, None]):
        if group and (w is None or size + len(w) + 1 > CHUNK):
            symbols, starts = _symbols(group)
            contexts = _contexts(symbols, starts)
            owner = np.repeat(np.arange(first, first + len(group)), np.diff(starts, append=len(symbols)))
            for low in range(0, len(symbols), SLICE):
                part = symbols[low : low + SLICE]
                length = code.length[part]
                ends = np.cumsum(length)
                flat = np.repeat(code.start[part] - ends + length, length) + np.arange(ends[-1])
                slots = []
                for context, bits in zip(contexts, sizes, strict=True):
                    mixed = context[low : low + SLICE] * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(29)
                    h = np.repeat(mixed, length)
                    h += code.salt[flat]
                    h *= np.uint64(0x94D049BB133111EB)
                    h >>= np.uint64(64 - bits)
                    slots.append(h.view(np.int64))
                yield Bits(slots, flat, code.bit[flat], np.repeat(owner[low : low + SLICE], length))
            group, size, first = [], 0, i
        if w is not None:
            group.append(w)
            size += len(w) + 1


class Model:
    """What a shard has learnt of spelling its words from how often training has seen each; see `log10`."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        known = np.flatnonzero(counts > 0)
        words, counts = [words[i] for i in known.tolist()], counts[known].astype(np.float64)
        held = np.ones(257)
        if words:
            symbols, starts = _symbols(words)
            held += np.bincount(symbols, np.repeat(counts, np.diff(starts, append=len(symbols))), 257)
        self.code = prefix_code(held)
        bits = sum((len(w) + 1) * 8 for w in words)
        self.sizes = [min(most, max(LEAST_BITS, bits.bit_length())) for most in SLOT_BITS]
        self._train(lambda: _coded(words, self.code, self.sizes), counts, bits <= KEPT)

    def _train(self, coded, counts: np.ndarray, keep: bool) -> None:
        """Tables, weights and refinement from what each pass over the coded bits of the items, seen `counts` times, yields."""
        self.tables = [np.zeros(2 << b, np.float32) for b in self.sizes]
        kept = list(coded()) if keep else None
        for b in kept or coded():
            for table, slot in zip(self.tables, b.slots, strict=True):
                np.add.at(table, 2 * slot + b.bit, counts[b.owner].astype(np.float32))
        self.weights = np.full((INPUTS, 64), 0.3, np.float32)
        self.nodes = int(self.code.node.max()) + 1
        middle = 1 / (1 + np.exp(-np.linspace(-SPAN, SPAN, BUCKETS)))
        ones, all_ = np.tile(middle * 20, self.nodes), np.full(self.nodes * BUCKETS, 20.0)
        kept = [(b._replace(slots=[]), self._inputs(b, 1)) for b in kept] if keep else None

        def bits():
            return kept or ((b, self._inputs(b, 1)) for b in coded())

        for epoch in range(EPOCHS):
            for b, (odds, gate) in bits():
                self._learn(odds, gate, b.bit, counts[b.owner], max(LEAST, RATE / (1 + epoch)))
        for b, inputs in bits():
            mixed = self._mixed(*inputs)
            where, weight = self.code.node[b.step] * BUCKETS + _strength(mixed), counts[b.owner]
            ones += np.bincount(where, weight * b.bit, len(ones))
            all_ += np.bincount(where, weight, len(all_))
        self.refine = np.log(ones / (all_ - ones)).astype(np.float32)

    def _inputs(self, b: Bits, less: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The log odds of every predictor, with `less` sightings of the bit itself, and the gate."""
        odds, seen = [], []
        one = b.bit.astype(np.float32)
        for table, slot in zip(self.tables, b.slots, strict=True):
            both = table.view(np.complex64)[slot]  # one look for both counts
            n0, n1 = both.real, both.imag
            if less:
                n0, n1 = n0 - (1 - one), n1 - one
            odds.append(np.clip(np.log((n1 + np.float32(0.1)) / (n0 + np.float32(0.1))), -SPAN, SPAN))
            seen.append(n0 + n1)
        low, high = (STRATUM[np.minimum(seen[k], len(STRATUM) - 1).astype(np.int64)] for k in LONG)
        return odds, low * 8 + high

    def _mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return _mixture(self.weights, odds, gate)

    def _learn(self, odds: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One gradient step per batch of bits and gate, on the mean over the batch's occurrences."""
        for a in range(0, len(bit), BATCH):
            x, g, c = [o[a : a + BATCH] for o in odds], gate[a : a + BATCH], weight[a : a + BATCH]
            error = c * (bit[a : a + BATCH] - 1 / (1 + np.exp(-self._mixed(x, g).astype(np.float64))))
            share = rate / np.maximum(np.bincount(g, c, 64), 1)
            for k in range(INPUTS):
                self.weights[k] += (share * np.bincount(g, error * x[k], 64)).astype(np.float32)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word inside its shard."""
        out = np.zeros(len(words))
        for b in _coded(words, self.code, self.sizes):
            mixed = self._mixed(*self._inputs(b, 0))
            final = (mixed + self.refine[self.code.node[b.step] * BUCKETS + _strength(mixed)]) / 2  # the mean of both
            cost = np.log1p(np.exp(np.where(b.bit, -final, final).astype(np.float64)))
            first = np.flatnonzero(np.concatenate(([True], b.owner[1:] != b.owner[:-1])))  # of each item
            out[b.owner[first]] -= np.add.reduceat(cost, first)
        return out / np.log(10)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each among them."""
    order = np.argsort(values)
    values = values[order]
    new = np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return values[new], place


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _mixture(weights: np.ndarray, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    total = weights[0].take(gate) * odds[0]
    for w, x in zip(weights[1:], odds[1:], strict=True):
        total += w.take(gate) * x
    return np.clip(total, -12, 12, out=total)


def _odds(taken: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The log odds of the way taken, from how often it and the other way were."""
    odds = taken + np.float32(0.1)
    odds /= other + np.float32(0.1)
    np.log(odds, out=odds)
    return np.clip(odds, -SPAN, SPAN, out=odds)


class Items(NamedTuple):
    """Different symbols after different contexts, and their training occurrences.

    For the word before the last, the last, and both, in whose order the items are: where an item's numbers
    start, and the numbers, how often training saw the nodes of its path after its context, from the root to the symbol.
    """

    symbol: np.ndarray
    counts: np.ndarray
    seen: list[tuple[np.ndarray, np.ndarray]]


class Chain:
    """What a shard has learnt of words after the two before them, from how often training has seen each such three.

    The code is that of the words seen in the shard and of an escape for any other; its bits are predicted
    from nothing, the word before the last, the last word, and both. Words seen once train the escape as well.
    As all threes are known, each context's counts are summed over its sorted symbols instead of looked up bit
    by bit, and log odds are those of the bit that follows, whichever it is.
    """

    def __init__(self, last: np.ndarray, earlier: np.ndarray, word: np.ndarray, counts: np.ndarray):
        words, each = _distinct(word)
        held = np.bincount(each, counts)
        known = held > 0
        self.words, held = words[known], held[known]
        symbol = np.where(known, np.cumsum(known) - 1, len(held))[each]
        once = np.flatnonzero((counts > 0) & (np.append(held, 0)[symbol] == 1))
        held = np.concatenate((held, [len(once), 0]))
        self._plant(held)
        escapes = np.full(len(once), len(self.words))
        self.threes = [np.concatenate(x) for x in ((last, last[once]), (earlier, earlier[once]), (symbol, escapes), (counts, counts[once]))]
        self.given, (self.items, self.place) = len(word), self._items(*self.threes)
        self._train()

    def _plant(self, held: np.ndarray) -> None:
        """The code's tree, and what it alone predicts, with every sighting and with one less."""
        self.code = code = prefix_code(held)
        depth = np.arange(len(code.node)) - np.repeat(code.start, code.length)
        self.path = np.add.reduceat(code.bit.astype(np.uint64) << (63 - depth).astype(np.uint64), code.start)
        self.leaf = np.empty(len(held), np.uint64)
        self.leaf[np.argsort(self.path)] = np.arange(len(held), dtype=np.uint64)
        all_ = np.bincount(code.node, np.repeat(held, code.length)).astype(np.float32)[code.node]
        taken = np.append(all_[1:], 0)
        taken[code.start + code.length - 1] = held
        self.alone = [_odds(np.maximum(taken - less, 0), all_ - taken) for less in (0, 1)]
        self.bucket = ((2 * np.minimum(len(held) - 2 - code.node, PLACES - 1) + code.bit) * BUCKETS).astype(np.int32)  # rare nodes share theirs

    def _symbols(self, word: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, word)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == word[known]
        return np.where(known, at, len(self.words))

    def _items(self, last: np.ndarray, earlier: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> tuple[Items, np.ndarray]:
        """The items in order of contexts, and that of each three."""
        both = ((_mix(last) >> np.uint64(64 - FRONT)) << np.uint64(NEAR)) | (_mix(last, earlier) >> np.uint64(64 - NEAR))
        place, first, *seen = self._seen(both, symbol, counts)
        symbol, counts = symbol[first], np.bincount(place, counts, len(first)).astype(np.float32)
        found = []
        for context in (earlier[first], last[first]):
            at, _, start, numbers = self._seen(_mix(context) >> np.uint64(64 - FRONT - NEAR), symbol, counts)
            found.append((start[at], numbers))
        return Items(symbol, counts, [*found, tuple(seen)]), place

    def _seen(self, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The different symbols of each context: the place of each item's, an item of each, where its numbers start, and they."""
        width = np.uint64(len(self.leaf).bit_length())
        key = (context << width) | self.leaf[symbol]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        weight = np.add.reduceat(counts[order].astype(np.float32), np.flatnonzero(new))
        first, key = order[new], key[new]
        path, size = self.path[symbol[first]], self.code.length[symbol[first]] + 1
        parted = path[1:] ^ path[:-1]
        shared = 64 - np.frexp((parted & ~(parted >> np.uint64(1))).astype(np.float64))[1]  # steps in common with the one before
        shared[(key[1:] ^ key[:-1]) >> width > 0] = -1
        shared = np.concatenate(([-1], shared)).astype(np.int32)
        start = np.cumsum(size) - size
        numbers, at, depth = np.repeat(weight, size), start, 0
        while len(at):  # a symbol alone below a node of its context is done
            edges = np.flatnonzero(shared < depth)
            n = np.diff(edges, append=len(at))
            several = n > 1
            going = np.repeat(several, n)
            total = np.repeat(np.add.reduceat(weight, edges)[several], n[several])
            at, weight, shared = at[going], weight[going], shared[going]
            numbers[at + depth] = total
            depth += 1
        return place, first, start, numbers

    def _predicted(self, numbers: np.ndarray, less: int, kind: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Log odds of each number's next step, and what the gate has of it; at the end of a path they mean nothing."""
        odds = np.empty(len(numbers), np.float32)
        gate = np.empty(len(numbers), np.uint8) if GATED[kind] else None
        for low in range(0, len(numbers) - 1, CHUNK):
            taken = numbers[low + 1 : low + 1 + CHUNK]
            all_, high = numbers[low : low + len(taken)], low + len(taken)
            odds[low:high] = _odds(np.maximum(taken - less, 0), np.maximum(all_ - taken, 0))
            if gate is not None:
                gate[low:high] = STRATA.take(np.clip(all_ - less, 0, len(STRATA) - 1).astype(np.int32)) * np.uint8(GATED[kind])
        return odds, gate

    def _inputs(self, items: Items, less: int):
        """In slices of about STEPS bits: the items, where each one's bits start, the steps, log odds and gates; with `less`, of what training saw."""
        predicted = [(start, *self._predicted(numbers, less, k)) for k, (start, numbers) in enumerate(items.seen)]
        length = self.code.length[items.symbol] * (items.counts >= less)
        ends = np.cumsum(length)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], STEPS)), len(length))).tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            part, n = slice(low, high), length[low:high]
            first = np.cumsum(n) - n
            each = np.arange(n.sum())
            step = np.repeat(self.code.start[items.symbol[part]] - first, n) + each
            odds, gate = [self.alone[less].take(step)], np.zeros(len(step), np.uint8)
            for start, known, strata in predicted:
                at = np.repeat(start[part] - first, n) + each
                odds.append(known.take(at))
                if strata is not None:
                    gate += strata.take(at)
            yield part, first, step, odds, gate.astype(np.int64)

    def _train(self) -> None:
        """Weights online, each step on the mean over a slice's occurrences, and from the same pass the refinement."""
        self.weights = np.full((INPUTS, 64), 0.3, np.float32)
        total = np.zeros(2 * PLACES * BUCKETS)
        for part, first, step, odds, gate in self._inputs(self.items, 1):
            mixed = _mixture(self.weights, odds, gate)
            weight = np.repeat(self.items.counts[part], np.diff(first, append=len(step)))
            total += np.bincount(self.bucket.take(step) + _strength(mixed), weight, len(total))
            error = weight / (1 + np.exp(mixed))
            share = CHAIN_RATE / np.maximum(np.bincount(gate, weight, 64), 1)
            for k in range(INPUTS):
                self.weights[k] += (share * np.bincount(gate, error * odds[k], 64)).astype(np.float32)
        middle = 20 / (1 + np.exp(-np.linspace(-SPAN, SPAN, BUCKETS)))
        total = total.reshape(PLACES, 2, BUCKETS) + middle
        self.refine = np.log(total / total[:, ::-1, ::-1]).astype(np.float32).ravel()  # the other bit is as strong the other way

    def _costs(self, items: Items) -> np.ndarray:
        out = []
        for _, first, step, odds, gate in self._inputs(items, 0):
            mixed = _mixture(self.weights, odds, gate)
            final = (mixed + self.refine.take(self.bucket.take(step) + _strength(mixed))) / 2  # the mean of both
            out.append(np.add.reduceat(np.log(1 + np.exp(-final)), first, dtype=np.float64))
        return np.concatenate(out) / -np.log(10)

    def learnt(self) -> tuple[np.ndarray, np.ndarray]:
        """As `follow` for the threes that the shard was made of, seen in training or not."""
        return self._costs(self.items)[self.place[: self.given]], self.threes[2][: self.given] == len(self.words)

    def follow(self, last: np.ndarray, earlier: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each word, or of the escape, and where it is the escape."""
        symbol = self._symbols(word)
        asked = last, earlier, symbol, np.zeros(len(word))
        items, place = self._items(*(np.concatenate(x) for x in zip(asked, self.threes, strict=True)))
        return self._costs(items)[place[: len(word)]], symbol == len(self.words)


def _strength(mixed: np.ndarray) -> np.ndarray:
    return ((np.clip(mixed, -SPAN, SPAN) + (SPAN + SPAN / (BUCKETS - 1))) * ((BUCKETS - 1) / (2 * SPAN))).astype(np.int64)


ASK = [("block", "long"), ("shard", "long"), ("words", "binary"), ("counts", "binary"), ("tokens", "binary"), ("hashes", "binary"), ("sizes", "binary")]
TELL = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("held", pa.int64()), ("frequent", pa.binary()), ("counts", pa.binary()), ("costs", pa.binary())])
ASK_CHAIN = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("last", pa.binary()), ("earlier", pa.binary()), ("word", pa.binary()), ("counts", pa.binary())])
TELL_CHAIN = pa.schema([("block", pa.int64()), ("follows", pa.int64()), ("chained", pa.binary())])
END_WORD = b""  # no word is empty
WORD_BYTES, LAST_BYTES, EARLIER_BYTES = 5, 4, 3  # of a word's hash: as the word of a three, the one before, and the one before that
TOKEN_BYTES, COUNT_BYTES, COST_BYTES = 4, 6, 3
COST_UNIT, ESCAPED = 1 << 15, 1 << 23  # costs travel as whole numbers, of which one bit marks the escape


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _short(values: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of each number: first the lowest of all, then the next of all, and so on."""
    return np.ascontiguousarray(np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T[:size]).tobytes()


def _long(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return wide.view(np.uint64).ravel()


def _packed(values: np.ndarray, size: int) -> bytes:
    return zstandard.compress(_short(values, size), 1)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return _long(zstandard.decompress(raw), size)


def _rows(values: np.ndarray, size: int) -> bytes:
    """As `_packed`, but number by number, which is shorter where the same ones come again."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes(), 3)


def _from_rows(raw: bytes, size: int) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(-1, size)
    return np.pad(values, ((0, 0), (0, 8 - size))).view(np.uint64).ravel()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], list[bytes]]:
    """The tokens of all texts as numbers of words, the tokens and bytes of each text, and the words."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    found, ends = split.flatten(), np.diff(split.offsets.to_numpy()).cumsum()
    long = pc.binary_length(found).to_numpy()
    real = long > 0  # an empty text is split into an empty word
    before = np.concatenate(([0], np.cumsum(real)))[np.append(0, ends)]
    spelt = np.concatenate(([0], np.cumsum(long)))[np.append(0, ends)]
    held = np.diff(before)
    coded = found.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if END_WORD not in words:
        words.append(END_WORD)
    tokens = np.full(len(texts) + int(before[-1]), words.index(END_WORD), np.uint32)
    body = np.ones(len(tokens), bool)
    body[before[1:] + np.arange(len(texts))] = False
    tokens[body] = coded.indices.to_numpy()[real]
    return tokens, (held + 1, np.maximum(1, np.diff(spelt) + held - 1)), words


def _list_words(shards: int):
    """A block's words by shard, with their training counts, and a row of the block itself.

    That row has its texts as numbers: the place of each token's word among the words in order of shards,
    these words' hashes, and per text its tokens, bytes, and whether it is held out.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, sizes, words = _tokens(table["t"].combine_chunks())
        sizes = np.column_stack((*sizes, table["part"].to_numpy() == HELD_OUT)).astype(np.int64)
        train = np.repeat(sizes[:, 2] == 0, sizes[:, 0])
        counts = np.bincount(tokens[train], minlength=len(words))
        heads = pc.binary_slice(pa.array(words, pa.binary()), 0, PREFIX).dictionary_encode()
        shard = (_hashes(heads.dictionary.to_pylist()) % np.uint64(shards)).astype(np.int64)[heads.indices.to_numpy()]
        order = np.argsort(shard, kind="stable")
        words, counts, shard = [words[i] for i in order.tolist()], counts[order], shard[order]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        block = table["block"][0].as_py()
        rows = [{"block": block, "shard": s, "words": zstandard.compress(b" ".join(words[low:high])), "counts": _packed(counts[low:high], COUNT_BYTES)} for s, low, high in _runs(shard)]
        rows.append({"block": block, "tokens": _packed(place[tokens], TOKEN_BYTES), "hashes": _short(_hashes(words), WORD_BYTES), "sizes": _packed(sizes.T.ravel(), COUNT_BYTES)})
        made = pa.Table.from_pylist(rows, schema=pa.schema([(name, {"long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in ASK]))
        keys = table["k"].combine_chunks()
        ends = pa.array([0] * len(rows) + [len(keys)], pa.int32())
        return made.append_column("keys", pa.ListArray.from_arrays(ends, keys))

    return run


def _model_words(spread: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts and costs of a shard's words back to each block that asked; n, v and frequent words stand in one row."""
        asked = [zstandard.decompress(x).split(b" ") for x in table["words"].to_pylist()]
        order = sorted({w for ws in asked for w in ws})  # what is learnt does not depend on the order of the rows
        place = dict(zip(order, range(len(order)), strict=True))
        total, index = np.zeros(len(order), np.int64), []
        for ws, raw in zip(asked, table["counts"].to_pylist(), strict=True):
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            total[at] += _unpacked(raw, COUNT_BYTES).astype(np.int64)
            index.append(at)
        costs, held = Model(order, total).log10(order).astype(np.float32), int(total.sum())
        often = np.flatnonzero(total >= spread)
        frequent = np.concatenate((_hashes([order[i] for i in often.tolist()]) , total[often].astype(np.uint64))).tobytes()
        rows = [
            {"block": block, "shard": shard, "n": held * (i == 0), "v": int((total > 0).sum()) * (i == 0), "held": held, "frequent": None if i or not len(often) else frequent, "counts": _packed(total[at], COUNT_BYTES), "costs": costs[at].tobytes()}
            for i, (block, shard, at) in enumerate(zip(table["block"].to_pylist(), table["shard"].to_pylist(), index, strict=True))
        ]
        return pa.Table.from_pylist(rows, schema=TELL)

    return run


class Block(NamedTuple):
    """A block's tokens as different threes of words in a row, dealt to shards.

    sizes: tokens, bytes and whether held out, of each document; at: the word of each token; three: that of
    each token; last, earlier, word: hashes of each three, in order of shards; seen: its training occurrences.
    """

    sizes: np.ndarray
    at: np.ndarray
    three: np.ndarray
    last: np.ndarray
    earlier: np.ndarray
    word: np.ndarray
    seen: np.ndarray
    shard: np.ndarray


def _block(row: dict, shards: int, spread: int, frequent: np.ndarray) -> Block:
    sizes, at, words = _unpacked(row["sizes"], COUNT_BYTES).astype(np.int64).reshape(3, -1).T, _unpacked(row["tokens"], TOKEN_BYTES).astype(np.uint32), _long(row["hashes"], WORD_BYTES)
    tokens = sizes[:, 0]
    starts = np.cumsum(tokens) - tokens
    end = at[tokens[0] - 1]
    last = np.concatenate((at[:1], at[:-1]))
    last[starts] = end  # before the first word stands an end
    earlier = np.concatenate((at[:1], last[:-1]))
    earlier[starts] = end
    # the words after a frequent word are dealt to more shards, by the word before it
    parts, order = np.ones(len(words), np.uint64), np.argsort(words)
    often = frequent[0] % np.uint64(1 << 8 * WORD_BYTES)
    found = np.searchsorted(words[order], often)
    here = found < len(words)
    here[here] = words[order[found[here]]] == often[here]
    parts[order[found[here]]] += frequent[1][here] // np.uint64(spread)
    x, y = words[last], words[earlier]
    shard = _mix(x, _mix(y) % parts[last]) % np.uint64(shards)
    # in order of shards and of the word before; equal threes stand together
    x, y, upper = x % np.uint64(1 << 8 * LAST_BYTES), y % np.uint64(1 << 8 * EARLIER_BYTES), shards.bit_length()
    key = (shard << np.uint64(64 - upper)) | (x >> np.uint64(8 * LAST_BYTES - 24) << np.uint64(40 - upper)) | (_mix(last, earlier, at) >> np.uint64(24 + upper))
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = False
    for part in (last, earlier, at):
        part = part[order]
        new[1:] |= part[1:] != part[:-1]
    three = np.empty(len(order), np.int64)
    three[order] = np.cumsum(new) - 1
    first = order[new]
    seen = np.bincount(three[np.repeat(sizes[:, 2] == 0, tokens)], minlength=len(first))
    return Block(sizes, at, three, x[first], y[first], words[at[first]], seen, shard[first].astype(np.int64))


def _list_threes(shards: int, spread: int, frequent: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _block(row, shards, spread, frequent)
                gaps = np.diff(b.last, prepend=np.uint64(0))
                rows = [
                    {"shard": s, "block": row["block"], "last": _packed(np.append(b.last[low], gaps[low + 1 : high]), LAST_BYTES), "earlier": _short(b.earlier[low:high], EARLIER_BYTES), "word": _rows(b.word[low:high], WORD_BYTES), "counts": _packed(b.seen[low:high], COUNT_BYTES)}
                    for s, low, high in _runs(b.shard)
                ]
                yield from pa.Table.from_pylist(rows, schema=ASK_CHAIN).to_batches()

    return run


def _runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, start, end) of each run of equal shards."""
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist()
    return [(int(shard[low]), low, high) for low, high in zip(edges, edges[1:], strict=False)]


def _model_threes(table: pa.Table) -> pa.Table:
    """Costs of a shard's threes of words back to each block that asked, and where they are those of the escape."""
    table = table.sort_by("block")  # what is learnt does not depend on the order of the rows
    counted = [_unpacked(x, COUNT_BYTES).astype(np.int64) for x in table["counts"].to_pylist()]
    ends, counts = np.cumsum([len(x) for x in counted]), np.concatenate(counted)
    last = np.concatenate([np.cumsum(_unpacked(x, LAST_BYTES)) for x in table["last"].to_pylist()]) % np.uint64(1 << 8 * LAST_BYTES)
    earlier = np.concatenate([_long(x, EARLIER_BYTES) for x in table["earlier"].to_pylist()])
    word = np.concatenate([_from_rows(x, WORD_BYTES) for x in table["word"].to_pylist()])
    costs, escaped = Chain(last, earlier, word, counts).learnt()
    costs = np.minimum(np.rint(-costs * COST_UNIT), ESCAPED - 1).astype(np.int64) + escaped * ESCAPED
    rows = [
        {"block": block, "follows": shard, "chained": _packed(c, COST_BYTES)}
        for block, shard, c in zip(table["block"].to_pylist(), table["shard"].to_pylist(), np.split(costs, ends[:-1]), strict=True)
    ]
    return pa.Table.from_pylist(rows, schema=TELL_CHAIN)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settled(frame: DataFrame) -> DataFrame:
    """As `written`; the shuffle files behind the table, which nothing reads again, go with the job that made it."""
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return written(frame)
    finally:
        conf.set(CLEANUP, before)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null and empty texts are the end alone. A null key falls into the fold of the empty text; repeated
    rows count and are scored each. Without a training document N and V are 0. An empty table gives no
    rows. Texts are whole; a shard of words is one task's, and their number grows with the corpus.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), fold(F.col(key), FOLDS).cast("int").alias("part"))
    kind = rows.schema["k"].dataType.simpleString()
    blocks = BLOCK_SHARE * block_count(rows, "t")
    shards = SHARD_SHARE * blocks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)))
    listed = ", ".join(f"{name} {kind_}" for name, kind_ in ASK)
    asked = _settled(dealt.groupBy("block").applyInArrow(_list_words(shards), f"{listed}, keys array<{kind}>"))
    told = _settled(asked.filter("shard IS NOT NULL").select("shard", "block", "words", "counts").groupBy("shard").applyInArrow(_model_words(SPREAD), _ddl(TELL)))
    sums = told.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    # at most one word in SPREAD tokens is listed
    often = [np.frombuffer(r["frequent"], np.uint64).reshape(2, -1) for r in told.filter("frequent IS NOT NULL").select("frequent").collect()]
    frequent, spread = np.concatenate([np.zeros((2, 0), np.uint64), *often], 1), SPREAD

    texts = asked.filter("shard IS NULL").select("block", "tokens", "hashes", "sizes", "keys")
    threes = texts.drop("keys").mapInArrow(_list_threes(shards, spread, frequent), _ddl(ASK_CHAIN))
    followed = _settled(threes.groupBy("shard").applyInArrow(_model_threes, _ddl(TELL_CHAIN)))
    both = told.select("block", "shard", "held", "counts", "costs").unionByName(followed, allowMissingColumns=True)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        row, keys = table.drop_columns(["keys"]).to_pylist()[0], table["keys"].combine_chunks().flatten()
        b = _block(row, shards, spread, frequent)
        spelled, chains = answers.filter(pc.is_valid(answers["shard"])).sort_by("shard"), answers.filter(pc.is_valid(answers["follows"])).sort_by("follows")
        counts = np.concatenate([_unpacked(x, COUNT_BYTES) for x in spelled["counts"].to_pylist()]).astype(np.int64)
        costs = [np.frombuffer(x, np.float32) for x in spelled["costs"].to_pylist()]
        share = np.log10((np.array(spelled["held"].to_pylist()) + 1.0) / (n + shards))  # the probability of each shard
        apart = np.concatenate(costs) + np.repeat(share, [len(x) for x in costs])
        chained = np.concatenate([_unpacked(x, COST_BYTES) for x in chains["chained"].to_pylist()]).astype(np.int64)[b.three]
        each = np.where(chained >= ESCAPED, apart[b.at], 0.0) - chained % ESCAPED / COST_UNIT
        tokens = b.sizes[:, 0]
        first, c = np.cumsum(tokens) - tokens, counts[b.at]
        seen = np.add.reduceat((c > 0).astype(np.int64), first)
        base = np.add.reduceat(np.log10(c + 1.0), first) - tokens * float(np.log10(n + 1.0 * (v + 1)))
        made = np.add.reduceat(each, first)
        bits = -made * 3.321928094887362 / b.sizes[:, 1]
        return pa.Table.from_arrays(
            [keys, pa.array(b.sizes[:, 2] > 0), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), *(pa.array(x, pa.float64()) for x in (base, made, bits))],
            names=["k", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"],
        )

    schema = f"k {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    made = texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema).withColumn("train_tokens", F.lit(n).cast("long"))
    return made.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
