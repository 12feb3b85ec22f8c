"""LM scoring by a probabilistic suffix tree over words (1).

States are contexts of no, one or two words (Ron, Singer and Tishby, 1996).  Candidates are all
strings seen MIN_COUNT times or more; a context is kept where its next-word distribution diverges
from its suffix's by more than its observations explain.  A kept context gives discounted
probabilities to the words seen often after it, and the rest, in proportion, to its suffix's; the
empty context has the discounted counts of all words, and the discounts for unknown ones.  A text is
scored by the longest suffix of what was read that is a state.

Every word of a text is the context of just one next token, and so is every pair of words, so a
text's log-probability is a sum of weights of its words, pairs and triples: a word's is its own
log-probability and what it leaves to the suffix as a context; a pair's or triple's is what its
context adds to its suffix's log-probability, and again what it leaves.

Texts are stored once, as chunks of numbered words; the keys of strings are dealt into parts by
ranges.  A chunk asks each part about its distinct strings, in the order of their keys, and a part
answers in the same order, so that an answer needs no key:

1. of words and pairs: the chunk's counts go out, the sums over all chunks come back;
2. of words as contexts: what a part needs to judge them (each string is spoken for by one of the
   chunks that have it, which knows the counts of the string's words); the states come back.  Of
   triples of frequent pairs: counts;
3. of pairs as contexts, likewise.

Then a chunk knows the weights of all its strings, and scores its texts alone.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, documents_of, most_tasks, table, text_chunks, tidied

#: Least count of a state's string and of a word after it: what was seen once is no more than chance.
MIN_COUNT = 2
#: Strings of a length that the driver can look at.
HOT = 150_000
#: A context is kept if its log-likelihood gain (nats) passes so much, and one for each word after it.
MIN_GAIN, DISCOUNT = 10.0, 0.5
#: A discount takes no more of a word seen once, so that none is rated below an unseen word.
MOST_DISCOUNT = 0.5
#: Tokens of a chunk at most (one batch may have more), and of all texts for each part of the keys.
_TOKENS, _PART = 1_800_000, 1_500_000
#: All chunks are asked or scored in so many steps, and all parts answer in so many, for the disk that shuffles take meanwhile.
_STEPS = 4
_BITS = 20
#: Strings that are hashed at once, in a CPU's cache.
_AT_ONCE = 1 << 15
#: Bits of a set of keys that tasks ask first; it has all keys, and chance ones that a count or join then drops.
_SET_BITS = 26
_M63 = (1 << 63) - 1
#: In place of a context where there is none.
NONE = -1
#: Kinds of messages of a chunk, or to and from a part.
TEXTS, WORDS, PAIRS, TRIPLES, WORD_STATES, PAIR_STATES, TOTALS = range(7)
#: part: of texts, how many tokens they have.
_MESSAGE = "chunk long, part long, kind long, data binary"
_CODEC = pa.Codec("zstd", compression_level=1)


def _xx(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.asarray(seed).astype(np.uint64) + p5 + np.uint64(8)
    h = turn(h ^ (turn(x.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


#: Values of bytes in a word's hash, a sum of value * factor ** place; white space and A-Z fold.
_VALUE = np.array([0 if c in b"\t\n\v\f\r " else xxhash.xxh64_intdigest(bytes([c]).lower()) for c in range(256)], np.uint64)
_FACTOR, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
#: Bytes that are hashed at once, but for longer words.
_BLOCK = 1 << 19


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, ...]:
    """Powers of the factor and of its inverse, modulo 2 ** 64."""
    steps = (np.append(np.uint64(1), np.full(size, f, np.uint64)) for f in (_FACTOR, _INVERSE))
    return tuple(np.multiply.accumulate(v) for v in steps)


def _block_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, where each begins) of a block's words."""
    value = _VALUE[raw]
    inside = np.concatenate([[False], value != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(_BLOCK, 1 << len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:len(raw)])])
    h = (sums[end] - sums[begin]) * inverse[begin]
    return (_xx(h, (end - begin).astype(np.uint64)) >> np.uint64(1)).astype(np.int64), begin


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hashes, where each begins) of the words, A-Z in lower case, between \\x20 and \\x09-\\x0D."""
    raw, keys, begins, at = np.frombuffer(data, np.uint8), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        size, stop = _BLOCK, len(raw)
        while at + size < len(raw):
            gaps = np.flatnonzero(_VALUE[raw[at:at + size]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            size *= 2  # a word that is longer
        found, begin = _block_keys(raw[at:stop])
        keys.append(found)
        begins.append(begin + at)
        at = stop
    return np.concatenate(keys), np.concatenate(begins)


def word_key(word: bytes) -> int:
    return int(word_keys(word)[0][0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def string_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """63 bits for a string, from the keys of what precedes its last word and of its longest suffix."""
    return (_xx(suffix, _xx(context, np.uint64(42))) & np.uint64(_M63)).astype(np.int64)


def _string_key(context: str, suffix: str) -> Column:
    return F.xxhash64(context, suffix).bitwiseAND(F.lit(_M63))


#: The end's key; for chance to give it to a word is as unlikely as for two words to share theirs.
END = xxhash.xxh64_intdigest(b" ") >> 1


def _read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts' words and ends, where each text begins)."""
    keys, begin = word_keys(b" ".join(texts))
    stop = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(begin, stop)  # words up to each text's end
    x = np.insert(keys, words, END)
    return x, np.concatenate([[0], (words + np.arange(1, len(texts) + 1))[:-1]])


def _pairs(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of tokens that follow a word, places of those that follow two); texts in one array have fewer than 2 ** 31."""
    ok = np.ones(len(x), bool)
    ok[starts] = False
    two = ok.copy()
    two[starts[starts + 1 < len(x)] + 1] = False
    return np.flatnonzero(ok).astype(np.int32), np.flatnonzero(two).astype(np.int32)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of longs of 63 bits (their stable order, they in this order, whether each is another than the one before)."""
    bits = len(keys).bit_length()
    order = keys >> bits  # the upper bits are sorted together with their places
    order <<= bits
    order |= np.arange(len(keys))
    order.sort()
    order &= (1 << bits) - 1
    k = keys[order]
    wrong = np.flatnonzero(k[1:] < k[:-1])
    if len(wrong):  # different keys that share their upper bits
        upper = k >> bits
        at = np.flatnonzero(np.isin(upper, upper[wrong]))
        among = order[at]
        order[at] = among[np.lexsort((among, k[at]))]
        k[at] = keys[order[at]]
    return order, k, np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, each key's place among them)."""
    order, k, new = _grouped(keys)
    k, at = k[new], np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return k, at


def _strings(keys: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of strings of which the context and the suffix have these places among the keys."""
    out = np.empty(len(context), np.int64)
    for a in range(0, len(out), _AT_ONCE):
        at = slice(a, a + _AT_ONCE)
        out[at] = string_key(keys[context[at]], keys[suffix[at]])
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Longs, doubles or flags, by their bytes' places, as many as the largest has."""
    out = []
    for a in arrays:
        v = np.ascontiguousarray(a if a.dtype.itemsize == 8 else a.astype(np.int64)).view(np.uint64)
        width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
        data = _CODEC.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T[:width]), asbytes=True) if width else b""
        out += [struct.pack("<BQQ", width, len(v), len(data)), data]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as longs."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        width, n, size = struct.unpack_from("<BQQ", data, at)
        at += 17
        v = np.zeros((n, 8), np.uint8)
        if width:
            v[:, :width] = np.frombuffer(_CODEC.decompress(view[at:at + size], decompressed_size=width * n), np.uint8).reshape(width, n).T
        out.append(v.reshape(-1).view(np.int64))
        at += size
    return out


def _rising(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys to be packed: the first, and the steps."""
    return keys[:1], np.diff(keys)


def _risen(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([first, steps]))


def _sent(messages: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of _MESSAGE, some MB at once."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for m in messages:
        held.append(m)
        size += len(m[3]) + 100
        if size > 1 << 20:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(messages: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    *numbers, data = zip(*messages, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in numbers), pa.array(data, pa.binary())], names=["chunk", "part", "kind", "data"])


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)


def _text_messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """Chunks of texts: words by falling count and their numbers, which pack well; and of each text its tokens, id and uses."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    size, chunk = 0, TaskContext.get().partitionId() << 32

    def packed() -> bytes:
        words, at = _distinct(np.concatenate([x for x, _, _ in held]))
        often = np.argsort(-np.bincount(at), kind="stable")
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often))
        doc_id, learn, asked = pa.concat_arrays([of for _, _, of in held]).flatten()
        return _pack(*_rising(words), often, rank[at], np.concatenate([n for _, n, _ in held]), doc_id.fill_null(0).to_numpy(),
                     *(v.to_numpy(zero_copy_only=False) for v in (doc_id.is_valid(), learn, asked)))

    for of, texts in text_chunks(batches):
        x, starts = _read(texts)
        if held and size + len(x) > _TOKENS:
            yield chunk, size, TEXTS, packed()
            held, size, chunk = [], 0, chunk + 1
        held.append((x, np.diff(np.append(starts, len(x))), of))
        size += len(x)
    if held:
        yield chunk, size, TEXTS, packed()


def _sums(of: np.ndarray, size: int, n: np.ndarray, lower: np.ndarray) -> list[np.ndarray]:
    """Of each of ``size`` contexts: how many strings follow, their counts' sum, and sums for the gain and for the rest;
    where one string follows, its ``lower`` in place of the former, which tells both."""
    left = n - DISCOUNT
    after = np.bincount(of, minlength=size)
    seen, gain, alone, taken = (np.bincount(of, v, size) for v in (n, left * (np.log10(left) - lower), lower, 10.0 ** lower))
    return [after, seen.astype(np.int64), np.where(after == 1, alone, gain), taken]


class _Chunk:
    """A chunk's texts with what it was told of its strings so far."""

    def __init__(self, number: int, messages: Iterable[tuple[int, int, int, bytes]], tree: SuffixTree | None = None):
        self.number, self.tree = number, tree
        self._told: dict[int, list[bytes]] = defaultdict(list)
        for _, _, kind, data in messages:  # in the order of parts
            self._told[kind].append(data)
        first, steps, often, rank, sizes, self.doc_id, valid, learn, asked = _unpack(self._told.pop(TEXTS)[0])
        self.words, self.x, self.sizes = _risen(first, steps), often.astype(np.int32)[rank], sizes
        del rank
        self.starts = np.cumsum(sizes) - sizes
        self.no_id, self.asked = valid == 0, asked > 0
        self.learned = np.repeat(learn > 0, sizes)
        self.one, self._two = _pairs(self.x, self.starts)
        context, word = self.x[self.one - 1], self.x[self.one]
        self.pairs, at = _distinct(_strings(self.words, context, word))
        self.context, self.word = (np.empty(len(self.pairs), np.int32) for _ in range(2))
        self.context[at], self.word[at] = context, word
        self.pair = np.full(len(self.x), NONE, np.int32)  # of each token, with the one before
        self.pair[self.one] = at

    def counts(self, places: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
        """In training texts, of strings that end at the places."""
        return np.bincount(number[self.learned[places]], minlength=size)

    def asks(self, kind: int, keys: np.ndarray, parts: int, about: Callable[[slice], list[np.ndarray]]) -> Iterator[tuple[int, int, int, bytes]]:
        """Messages to the parts about distinct keys in order."""
        stop = np.searchsorted(((keys >> 31) * parts) >> 32, np.arange(parts), "right")
        for part, (a, b) in enumerate(zip(np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True)):
            if a < b:
                yield self.number, part, kind, _pack(*_rising(keys[a:b]), *about(slice(a, b)))

    def asks_states(self, kind: int, keys: np.ndarray, n: np.ndarray, sums: list[np.ndarray], parts: int) -> Iterator[tuple[int, int, int, bytes]]:
        """Of contexts that can be states, with their counts and sums where this chunk speaks for strings after them."""
        can = n >= MIN_COUNT
        n, *sums, taken = (v[can] for v in (n, *sums))
        has, several = sums[0] > 0, sums[0] > 1
        return self.asks(kind, keys[can], parts, lambda at: [has[at], *(v[at][has[at]] for v in (n, *sums)), taken[at][several[at]]])

    def _counted(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        told = np.concatenate([np.zeros(0, np.int64), *(_unpack(d)[0] for d in self._told.pop(kind, ()))])
        return told >> 1, (told & 1) > 0

    def _rest(self, kind: int, n: np.ndarray) -> np.ndarray:
        """What contexts leave to their suffixes, log10; NaN of no states."""
        told = [_unpack(d) for d in self._told.pop(kind, ())]
        kept, rest = (np.concatenate([np.zeros(0, np.int64), *(t[i] for t in told)]) for i in range(2))
        can = np.full(len(kept), np.nan)
        can[kept > 0] = rest.view(np.float64)
        out = np.full(len(n), np.nan)
        out[n >= MIN_COUNT] = can
        return out

    def hear_counts(self) -> None:
        """Counts of words and pairs, and the triples that matter by them."""
        (self.word_n, self.word_speaks), (self.pair_n, self.pair_speaks) = self._counted(WORDS), self._counted(PAIRS)
        self.root = self.tree.log(self.word_n)
        often = self.pair_n >= MIN_COUNT
        self.three = self._two[often[self.pair[self._two]] & often[self.pair[self._two - 1]]]
        context, suffix = self.pair[self.three - 1], self.pair[self.three]
        self.triples, self.triple = _distinct(_strings(self.pairs, context, suffix))
        self.triple_context, self.triple_suffix = (np.empty(len(self.triples), np.int32) for _ in range(2))
        self.triple_context[self.triple], self.triple_suffix[self.triple] = context, suffix

    def hear_word_states(self) -> None:
        self.triple_n, self.triple_speaks = self._counted(TRIPLES)
        self.word_rest = self._rest(WORD_STATES, self.word_n)
        self.pair_log, self.pair_gain = self._level(self.pair_n, self.context, self.word_n, self.word_rest, self.root[self.word])

    def hear_pair_states(self) -> None:
        self.pair_rest = self._rest(PAIR_STATES, self.pair_n)
        self.triple_log, self.triple_gain = self._level(self.triple_n, self.triple_context, self.pair_n, self.pair_rest, self.pair_log[self.triple_suffix])

    @staticmethod
    def _level(n: np.ndarray, context: np.ndarray, context_n: np.ndarray, rest: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the last word's probability by the longest state, what the context adds) of strings; the latter is 0 of rare ones."""
        rest = rest[context]
        kept = ~np.isnan(rest) & (n >= MIN_COUNT)
        log = np.array(lower)
        log[kept] = np.log10(n[kept] - DISCOUNT) - np.log10(context_n[context[kept]])
        return log, np.where(kept, log - rest - lower, 0.0)

    def scores(self) -> tuple[np.ndarray, ...]:
        """(known words, base score, score) of each text."""
        word = np.where(self.word_n > 0, self.root + np.nan_to_num(self.word_rest), self.tree.unknown)
        pair = self.pair_gain + np.nan_to_num(self.pair_rest)
        log = word[self.x]
        log[self.one] += pair[self.pair[self.one]]
        log[self.three] += self.triple_gain[self.triple]
        each = (self.word_n > 0).astype(np.int64)[self.x], self.tree.base(self.word_n)[self.x], log
        return tuple(np.add.reduceat(v, self.starts) for v in each)


def _chunks(batches: Iterable[pa.RecordBatch], tree: SuffixTree | None = None) -> Iterator[_Chunk]:
    for number, own in itertools.groupby(_messages(batches), key=lambda m: m[0]):
        yield _Chunk(number, own, tree)


def _ask_counts(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    for c in _chunks(batches):
        everywhere = np.arange(len(c.x))
        for kind, keys, places, number in ((WORDS, c.words, everywhere, c.x), (PAIRS, c.pairs, c.one, c.pair[c.one])):
            n = c.counts(places, number, len(keys))
            yield from c.asks(kind, keys, parts, lambda at, n=n: [n[at]])


def _ask_word_states(batches: Iterable[pa.RecordBatch], tree: SuffixTree, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    for c in _chunks(batches, tree):
        c.hear_counts()
        own = c.pair_speaks
        yield from c.asks_states(WORD_STATES, c.words, c.word_n, _sums(c.context[own], len(c.words), c.pair_n[own], c.root[c.word[own]]), parts)
        n = c.counts(c.three, c.triple, len(c.triples))
        yield from c.asks(TRIPLES, c.triples, parts, lambda at, n=n: [n[at]])


def _ask_pair_states(batches: Iterable[pa.RecordBatch], tree: SuffixTree, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    for c in _chunks(batches, tree):
        c.hear_counts()
        c.hear_word_states()
        own = c.triple_speaks
        yield from c.asks_states(PAIR_STATES, c.pairs, c.pair_n, _sums(c.triple_context[own], len(c.pairs), c.triple_n[own], c.pair_log[c.triple_suffix[own]]), parts)


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """Of each part and kind what its chunks asked."""
    for (part, kind), own in itertools.groupby(_messages(batches), key=lambda m: m[1:3]):
        chunks, asked = [], []
        for chunk, _, _, data in own:
            chunks.append(chunk)
            asked.append(_unpack(data))
        keys = [_risen(*a[:2]) for a in asked]
        stop = np.cumsum([len(k) for k in keys]).tolist()
        order, _, new = _grouped(np.concatenate(keys))
        del keys, _
        first, back = np.flatnonzero(new), np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1  # from a question to its key's place
        if kind in (WORD_STATES, PAIR_STATES):
            kept, rest = _judged([a[2:] for a in asked], back, len(first))
            kept, rest = kept[back], rest[back]
            answer = lambda at: [kept[at], rest[at][kept[at]]]  # noqa: B023, E731
        else:
            n = np.add.reduceat(np.concatenate([a[2] for a in asked])[order], first)
            if kind == WORDS:
                yield NONE, part, TOTALS, _pack(np.array([n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum()]))
            told = n[back] * 2
            told[order[first]] += 1  # the chunk that speaks for the string
            told[told < 2 * (1 if kind == WORDS else MIN_COUNT)] = 0
            answer = lambda at: [told[at]]  # noqa: B023, E731
        del asked
        for chunk, a, b in zip(chunks, [0, *stop], stop, strict=False):
            yield chunk, part, kind, _pack(*answer(slice(a, b)))


def _judged(asked: list[list[np.ndarray]], at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether kept, what is left to the suffix) of contexts, from all chunks' counts and sums."""
    at = at[np.concatenate([a[0] for a in asked]) > 0]
    n, after, seen, gain, more = (np.concatenate([a[i] for a in asked]) for i in range(1, 6))
    gain, taken, one = gain.view(np.float64), np.empty(len(at)), after == 1
    taken[~one], taken[one] = more.view(np.float64), 10.0 ** gain[one]
    gain[one] = (seen[one] - DISCOUNT) * (np.log10(seen[one] - DISCOUNT) - gain[one])
    context_n = np.ones(size)
    context_n[at] = n  # all agree
    after, seen, gain, taken = (np.bincount(at, v, size) for v in (after, seen, gain, taken))
    own = seen - DISCOUNT * after
    left = 1 - own / context_n
    rest = np.log10(np.maximum(left, 1e-12) / np.maximum(1 - taken, 1e-12))
    gain = gain - own * np.log10(context_n) + np.maximum(left, 0.0) * context_n * rest  # of all observations
    return (after > 0) & (gain * float(np.log(10)) > MIN_GAIN + after), rest


def _told_scores(batches: Iterable[pa.RecordBatch], tree: SuffixTree) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches, tree):
        if c.asked.any():
            c.hear_counts()
            c.hear_word_states()
            c.hear_pair_states()
            columns = c.sizes, *c.scores()
            yield pa.RecordBatch.from_arrays([pa.array(c.doc_id[c.asked], pa.int64(), mask=c.no_id[c.asked]), *(pa.array(v[c.asked]) for v in columns)],
                                             names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _told_strings(batches: Iterable[pa.RecordBatch], tree: SuffixTree) -> Iterator[pa.RecordBatch]:
    """All strings of the tree, from the chunks that speak for them."""
    for c in _chunks(batches, tree):
        c.hear_counts()
        c.hear_word_states()
        c.hear_pair_states()
        none = np.full(len(c.words), NONE)
        for words, own, context, suffix, n, log, rest in (
                (1, c.word_speaks, none, c.words, c.word_n, c.root, c.word_rest),
                (2, c.pair_speaks, c.words[c.context], c.words[c.word], c.pair_n, c.pair_log, c.pair_rest),
                (3, c.triple_speaks, c.pairs[c.triple_context], c.pairs[c.triple_suffix], c.triple_n, c.triple_log, np.full(len(c.triples), np.nan))):
            columns = context, suffix, n, log, rest
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), words)), *(pa.array(v[own], from_pandas=True) for v in columns)],
                                             names=["words", "context", "suffix", "n", "log", "rest"])


_ALL_STRINGS = "words long, context long, suffix long, n long, log double, rest double"


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << 13, np.int64)
    bits[rows["at"].to_numpy() & ((1 << 13) - 1)] = rows["bits"].to_numpy()
    return pd.DataFrame({"block": [key[0]], "bits": [bits.tobytes()]})


class KeySet:
    """Bits of keys: all of the given ones are in it, and some others."""

    def __init__(self, keys: DataFrame):
        place = F.col("key").bitwiseAND(F.lit((1 << _SET_BITS) - 1))
        longs = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
        blocks = longs.groupBy(F.shiftright("at", 13).alias("block")).applyInPandas(_packed, "block long, bits binary").collect()  # 2 ** (_SET_BITS - 19) rows at most
        self.bits = np.zeros(1 << (_SET_BITS - 6), np.int64)
        for r in blocks:
            self.bits[r["block"] << 13:(r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return (self.bits[(keys & ((1 << _SET_BITS) - 1)) >> 6] >> (keys & 63)) & 1 > 0


class _States:
    """Frequent contexts of one length, by number, with the frequent words after each: keys are context << 20 | word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, log: np.ndarray, rest: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts, self.log = keys[order], counts[order], log[order]
        self.kept, self.rest = ~np.isnan(rest), np.nan_to_num(rest)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The key's place, -1 where there is none; a negative context or word has none."""
        if not len(self.keys):
            return np.full(len(context), -1)
        key = np.where((context >= 0) & (word >= 0), context << _BITS | np.maximum(word, 0), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def after(self, context: np.ndarray, at: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return lower
        kept = (context >= 0) & self.kept[np.maximum(context, 0)]
        return np.where(kept, np.where(at >= 0, self.log[np.maximum(at, 0)], self.rest[np.maximum(context, 0)] + lower), lower)


class SuffixTree:
    """What all tasks need of the tree; on the driver also its strings, of which the frequent words (in falling order of
    their counts) and pairs are loaded when one of them is first asked for."""

    def __init__(self, total: int, distinct: int, once: int, twice: int):
        self.total, self.distinct = total, distinct
        # where no word occurs twice, what is seen still keeps a share
        self.discount = min(MOST_DISCOUNT, once / (once + 2 * twice)) if once else DISCOUNT
        # what the discounts leave is shared by as many unseen words as there are seen ones, and one more
        self.unknown = float(np.log10(self.discount * distinct / max(1, total) / (distinct + 1))) if total else 0.0

    def least(self) -> int:
        """Least count of a frequent word or pair."""
        return self._least

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def log(self, count: np.ndarray) -> np.ndarray:
        """log10 of a word's probability by the empty context; NaN of unknown ones."""
        return np.log10(np.where(count > 0, count - self.discount, np.nan) / max(1, self.total))

    def __getattr__(self, name: str):
        if name not in ("words", "counts", "root", "word_rest", "contexts", "pairs", "_least") or "strings" not in self.__dict__:
            raise AttributeError(name)
        self._load()
        return self.__dict__[name]

    def _load(self) -> None:
        words, pairs = (self.strings.where(F.col("words") == k) for k in (1, 2))
        self._least = max(_hot_count(words), _hot_count(pairs))
        self.learn_words(*_columns(words.where((F.col("n") >= self._least) | (F.col("suffix") == END)), "suffix", "n", "log", "rest"))
        self.learn_pairs(*_columns(pairs.where(F.col("n") >= self._least), "context", "suffix", "n", "log"))

    def learn_words(self, words: np.ndarray, counts: np.ndarray, root: np.ndarray, rest: np.ndarray) -> None:
        order = np.lexsort((words, -counts))
        self.words, self.counts, self.root, self.word_rest = (v[order] for v in (words, counts, root, rest))
        self.contexts = int((self.counts >= self.least()).sum())  # a prefix, as counts fall

    def learn_pairs(self, context: np.ndarray, word: np.ndarray, counts: np.ndarray, log: np.ndarray) -> None:
        by_key = np.argsort(self.words)
        a, b = (by_key[np.searchsorted(self.words, k, sorter=by_key)] for k in (context, word))
        self.pairs = _States(a << _BITS | b, counts, log, self.word_rest)

    def __getstate__(self) -> dict:
        """What tasks ask."""
        return {k: self.__dict__[k] for k in ("total", "distinct", "discount", "unknown")}

    def after_word(self, context: np.ndarray, word: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 of a word's probability after a one-word context (-1: none), given its root's."""
        return self.pairs.after(context, self.pairs.find(context, word), root)

    def indexed(self) -> dict[int, int]:
        return {int(k): i for i, k in enumerate(self.words.tolist())}


def _hot_count(rows: DataFrame) -> int:
    """The least count, MIN_COUNT or more, that at most HOT of the rows have or pass."""
    hot = 0
    for r in sorted(rows.groupBy("n").count().collect(), key=lambda r: -r["n"]):  # n rows have few different counts
        hot += r["count"]
        if hot > HOT:
            return max(MIN_COUNT, r["n"] + 1)
    return MIN_COUNT


def _columns(hot: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of at most HOT rows; nulls are NaN."""
    rows = hot.select(*names).toPandas()
    return [rows[c].to_numpy(np.int64 if c in ("key", "context", "suffix") else np.float64) for c in names]


def _dealt(messages: DataFrame, values: int, *by: str) -> DataFrame:
    """All rows of each of the first column's values in one task, in order."""
    return messages.repartition(by[0]).sortWithinPartitions(*by).coalesce(max(values, most_tasks(messages.sparkSession)))


class _Told:
    """Tables of all that chunks were told so far, and the chunks themselves."""

    def __init__(self, chunks: int, tables: list[DataFrame]):
        self.chunks, self.tables = chunks, tables

    def dealt(self) -> list[DataFrame]:
        """The messages of each chunk in one task and in order, some of the chunks at once."""
        steps = max(1, min(_STEPS, self.chunks))
        told = functools.reduce(DataFrame.unionAll, self.tables).where(F.col("chunk") != NONE)
        step = F.pmod(F.xxhash64("chunk"), F.lit(steps))
        return [_dealt(told.where(step == k), self.chunks, "chunk", "kind", "part") for k in range(steps)]


def fit(texts: DataFrame, scratch: Scratch) -> tuple[SuffixTree, _Told]:
    """(the tree, all that chunks of texts are told of their strings) of texts (doc_id, text), and which are learned from
    (learn) and are to be scored (asked); without these all are learned from."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if "learn" not in texts.columns:
        texts = texts.withColumns({"learn": F.lit(True), "asked": F.lit(False)})

    def mapped(messages: DataFrame, task: Callable, *args) -> DataFrame:
        return messages.mapInArrow(lambda b: tidied(_sent(task(b, *args))), _MESSAGE)

    def write(messages: DataFrame, name: str, by: str | None = None) -> DataFrame:
        return scratch.write(messages, name, keep_shuffles=False, by=by)

    def answers(asked: DataFrame, name: str) -> DataFrame:
        return write(mapped(_dealt(asked, parts, "part", "kind", "chunk"), _answers), name)

    def told_by_steps(task: Callable, name: str) -> list[DataFrame]:
        """What the parts answer, some of them at once, to what the chunks ask, some of them at once."""
        steps = min(_STEPS, parts)
        step = (F.col("part") * steps / parts).cast("long").alias("step")
        asked = [write(mapped(own, task, tree, parts).select("*", step), f"ask-{name}", by="step") for own in told.dealt()]
        got = []
        for k in range(steps):
            own = functools.reduce(DataFrame.unionAll, (a.where(F.col("step") == k).drop("step") for a in asked))
            got.append(answers(own, name))
            scratch.drop(*asked, only=f"step={k}")
        return got

    # numbered once and stored: chunks that are made anew for each use need not agree
    chunks = write(mapped(texts.select(F.struct("doc_id", "learn", "asked").alias("of"), "text"), _text_messages), "chunks")
    held, tokens = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("part"), F.lit(0))).first()
    parts = 1 + tokens // _PART
    counts = answers(mapped(chunks, _ask_counts, parts), "counts")
    totals = [_unpack(r["data"])[0] for r in counts.where(F.col("kind") == TOTALS).select("data").collect()]  # four numbers a part
    tree = SuffixTree(*sum(totals, np.zeros(4, np.int64)).tolist())
    told = _Told(held, [chunks, counts])
    told.tables += told_by_steps(_ask_word_states, "word-states")
    told.tables += told_by_steps(_ask_pair_states, "pair-states")
    tree.strings = functools.reduce(DataFrame.unionAll, (d.mapInArrow(lambda b: tidied(_told_strings(b, tree)), _ALL_STRINGS) for d in told.dealt()))
    return tree, told


def _scored(texts: DataFrame, spark) -> DataFrame:
    scratch = Scratch(spark, "suffix-tree")
    tree, told = fit(texts, scratch)
    scores = [scratch.write(d.mapInArrow(lambda b: tidied(_told_scores(b, tree)), _SCORES), "scores", keep_shuffles=False) for d in told.dealt()]
    scratch.drop(*told.tables)
    scores = functools.reduce(DataFrame.unionAll, scores)
    return scores.select("doc_id", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, by a tree of
    ``train``'s texts; scores are log10 probabilities of the words and the end.

    Null, empty and blank texts are the end alone.  Repeated rows are scored each.  Without training
    texts every word is unknown and all probabilities are 1.
    """
    used = lambda d, learn: documents_of(d, id_col, text_col).withColumns({"learn": F.lit(learn), "asked": F.lit(not learn)})
    return _scored(used(df, False).unionAll(used(train, True)), df.sparkSession)


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = documents_of(table(spark, sf_dir, "documents"))
    scored = _scored(docs.withColumns({"learn": ~held_out(F.col("doc_id")), "asked": F.lit(True)}), spark)
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
