"""BPE encoding and decoding by per-prefix dynamic programming (10).

For each prefix of a pre-token exactly one vocabulary token can end its BPE encoding.  The tokens
that end at a position are its matches in an automaton over the reversed vocabulary (every state
is a suffix of the text read so far); of these, the last token of the prefix is the one that may
stand after the last token of the prefix before it.  Whether two tokens may stand side by side is
tested by undoing their merges from the latest to the earliest along the boundary: they may unless,
at some moment, the two pieces that touch would have merged with each other first.  Back-pointers
from the whole pre-token give the ids.

All pre-tokens of a chunk are worked on together, position by position, with numpy; Spark deals out
the documents.  A task remembers the encodings of the words that it has met (a bounded number).
"""

from __future__ import annotations

import gc
import json
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import HashTable, documents_of, give_back, table, text_chunks

#: Unicode White_Space, at which no pre-token continues; Python's split() takes four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Beyond these, tables of characters differ between Unicode versions, and marks combine.
_WIDE = re.compile("[^\x00-ɏ]")
_BASE, _WORDS = 512, 120_000
#: Words whose ids alone are remembered (some 60 bytes a word), and bytes of those that are longer than _SHORT.
_IDS, _LONG_BYTES, _SHORT = 1 << 19, 8 << 20, 15
#: New words that are encoded at once for their ids.
_AT_ONCE = 4096
#: White space in every text, and letters and digits after which a sign at a word's end is a pre-token.
_GAP, _PLAIN = (np.array([chr(c) in x for c in range(256)]) for x in ("\t\n\v\f\r ", string.ascii_letters + string.digits))
#: Of eight bytes, the first so many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each begins, where it ends) of the words of a text, a last comma or full stop being a word."""
    inside = np.concatenate([[False], ~_GAP[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    last = raw[end - 1]
    cut = np.flatnonzero(((last == ord(",")) | (last == ord("."))) & (end - begin > 1) & _PLAIN[raw[end - 2]])
    sign = end[cut] - 1
    end[cut] = sign
    return np.insert(begin, cut + 1, sign), np.insert(end, cut + 1, sign + 1)


class WordIds:
    """Ids of the words met so far, one after another; words of at most _SHORT bytes are found by their bytes, as two longs."""

    def __init__(self, room: int):
        self.room, self.shift = room, np.uint64(64 - (2 * room - 1).bit_length())
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.low, self.high = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.start, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ids, self.used, self.words = np.zeros(4 * room, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return (((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of short words, -1 where there is none."""
        slot = self._slots(low, high)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = found = self.slots[slot[todo]]
            todo = todo[(found >= 0) & ((self.low[found] != low[todo]) | (self.high[found] != high[todo]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new words, no two the same; the first ``len(low)`` are short."""
        number = np.arange(self.words, self.words + len(counts), dtype=np.int32)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[number], self.count[number] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.words = self.used + len(ids), self.words + len(counts)
        self.low[number[:len(low)]], self.high[number[:len(low)]] = low, high
        slot, todo = self._slots(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = number[free]  # of several that want a slot the last gets it
            todo = todo[self.slots[slot[todo]] != number[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return number


class WordBpe:
    """The vocabulary's tables, and the encodings of words met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.shown = [self.tokens[i] for i in range(len(vocab))]
        self.decimal = [str(i) for i in range(len(vocab))]
        self.shown_size, self.decimal_size = (np.array([len(x) + 1 for x in y]) for y in (self.shown, self.decimal))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        library = Tokenizer.from_file(path)  # its character tables serve for rare scripts
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        n = len(vocab)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for a, b in merges:
            t = vocab[a + b]
            self.left[t], self.right[t] = vocab[a], vocab[b]
        made = np.flatnonzero(self.left >= 0)
        self.pairs = HashTable(self.left[made] << 17 | self.right[made], made)
        self._symbols(vocab)
        self._reversed_trie(n)
        # results of pair tests: a slot holds the last pair that came to it
        self.seen, self.fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.whole = np.ones(n, bool)
        self.whole[made] = self._compatible_walk(self.left[made], self.right[made], made)
        self.cache: dict[str, tuple[bytes, str, str]] = {}
        self.ids = WordIds(_IDS)

    def _symbols(self, vocab: dict[str, int]) -> None:
        """Ids of a byte inside and at the end of a pre-token; printable bytes stand for themselves,
        the others for the characters from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in shown}
        chars |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in chars)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + self.end] for b in range(256)], np.int64)
        self.byte_of = {c: b for b, c in chars.items()}

    def _reversed_trie(self, n: int) -> None:
        """States: suffixes of vocabulary tokens, read backwards; (state, symbol) -> state; state -> token."""
        spelled: dict[int, tuple[int, ...]] = {}
        for t in np.argsort(self.left >= 0, kind="stable").tolist():  # merges come in order of their ids
            a = int(self.left[t])
            spelled[t] = (t,) if a < 0 else spelled[a] + spelled[int(self.right[t])]
        step: dict[int, int] = {}
        ends, states = {}, 1
        for t, s in spelled.items():
            state = 0
            for x in reversed(s):
                key = state * _BASE + x
                if key not in step:
                    step[key], states = states, states + 1
                state = step[key]
            ends[state] = t
        self.step = HashTable(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))
        self.ends = np.full(states, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def _compatible_walk(self, a: np.ndarray, b: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """May a and b stand side by side?  ``allowed``: a merge of the two that doesn't count."""
        far = 1 << 40
        a, b = a.copy(), b.copy()
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        up_a, up_b = np.full(len(a), far), np.full(len(a), far)  # the merges that end the pieces' time
        while len(todo):
            x, y = a[todo], b[todo]
            m = self.pairs.get(x << 17 | y).astype(np.int64)
            if allowed is not None:
                m = np.where(m == allowed[todo], -1, m)
            # of equal merges the left one happens first
            bad = (m >= 0) & (m < up_a[todo]) & (m <= up_b[todo])
            ok[todo[bad]] = False
            more = ~bad & (np.maximum(x, y) >= _BASE)
            todo, x, y = todo[more], x[more], y[more]
            back_a = x > y  # undo the later merge; of two equal ones the right one
            i = todo[back_a]
            up_a[i], a[i] = a[i], self.right[a[i]]
            i = todo[~back_a]
            up_b[i], b[i] = b[i], self.left[b[i]]
        return ok

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 17 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.fits[slot]
        missing = np.flatnonzero(self.seen[slot] != key)
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            result = self._compatible_walk(new >> 17, new & 0x1FFFF)
            out[missing] = result[back]
            slot = slot[missing]
            self.seen[slot], self.fits[slot] = key[missing], out[missing]
        return out

    def encode_pretokens(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, how many ids each has); no pre-token is empty."""
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        stop = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        symbol = self.inner[raw]
        symbol[stop - 1] = self.final[raw[stop - 1]]
        level = np.arange(len(raw)) - np.repeat(stop - lengths, lengths)
        # every token that ends at a position
        at, state, found = np.arange(len(raw)), np.zeros(len(raw), np.int64), []
        size = 1
        while len(at):
            state = self.step.get(state * _BASE + symbol[at - size + 1]).astype(np.int64)
            on = state >= 0
            at, state = at[on], state[on]
            token = self.ends[state]
            hit = token >= 0
            found.append((at[hit], np.full(hit.sum(), size), token[hit]))
            on = level[at] >= size
            at, state = at[on], state[on]
            size += 1
        at, size, token = map(np.concatenate, zip(*found, strict=True))
        depth = level[at]
        order = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")  # short keys sort in linear time
        at, size, token = at[order], size[order], token[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        # the last token of each prefix
        last, back = np.full(len(raw), -1, np.int64), np.zeros(len(raw), np.int64)
        for k in range(len(bounds) - 1):
            i, s, t = (x[bounds[k]:bounds[k + 1]] for x in (at, size, token))
            whole = s == k + 1
            good = np.zeros(len(i), bool)
            good[whole] = self.whole[t[whole]]
            part = np.flatnonzero(~whole)
            before = last[i[part] - s[part]]
            part, before = part[before >= 0], before[before >= 0]
            good[part] = self._compatible(before, t[part])
            last[i[good]], back[i[good]] = t[good], s[good]
        # from each end back to the start
        here, first, word, picked = stop - 1, stop - lengths, np.arange(len(pretokens)), []
        while len(here):
            picked.append((word, last[here]))
            here = here - back[here]
            on = here >= first
            here, first, word = here[on], first[on], word[on]
        if not picked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, ids = map(np.concatenate, zip(*picked[::-1], strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(pretokens))

    def pretokens(self, word: str) -> list[bytes]:
        """The pre-tokens of a piece of text without white space or special tokens."""
        if word.isascii() or not _WIDE.search(word):
            word = word.lower()
            return [word.encode()] if word.isalpha() else [p.encode() for p in self.pattern.findall(word)]
        shown = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in shown]

    def words(self, text: str) -> list[str]:
        """Pieces whose encodings, one after another, are the text's; special tokens are pieces."""
        if "<|" in text:
            parts = self.splitter.split(text)
            if len(parts) > 1:
                return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words(p))]
        if text.isascii() or not _WIDE.search(text):
            text = text.lower()
        return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()

    def learn(self, documents: list[list[str]]) -> None:
        """Encode the words that aren't known yet."""
        if len(self.cache) > _WORDS:
            self.cache.clear()
        for t, i in self.special.items():
            self.cache[t] = (int(i).to_bytes(4, "little"), str(i), t)
        new = list(set().union(*documents).difference(self.cache))
        for at in range(0, len(new), 16_384):
            words = new[at:at + 16_384]
            split = [self.pretokens(w) for w in words]
            ids, counts = self.encode_pretokens([p for s in split for p in s])
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(s) for s in split])]
            self.cache.update(zip(words, self._spelled(ids, ends), strict=True))

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many ids each has)."""
        data = b" ".join(texts) + bytes(16)  # words are read eight bytes at a time
        raw = np.frombuffer(data, np.uint8)
        begin, end = word_places(raw[:-16])
        size = end - begin
        eight = np.ndarray(len(raw) - 7, "<u8", data, strides=(1,))
        low = eight[begin] & _FIRST[np.minimum(size, 8)]
        high = eight[np.minimum(begin + 8, len(eight) - 1)] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        number = np.full(len(begin), -1, np.int32)
        short, long = np.flatnonzero(size <= _SHORT), np.flatnonzero(size > _SHORT)
        low, high, words = low[short], high[short], [data[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
        for _ in range(2):
            number[short] = self.ids.find(low, high)
            new = np.flatnonzero(number[short] < 0)
            new = new[np.lexsort((high[new], low[new]))]
            new = new[np.concatenate([[True], (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])])] if len(new) else new
            new_long = list(set(words).difference(self.ids.long))
            if not self.ids.words or self.ids.words + len(new) + len(new_long) <= self.ids.room and self.ids.long_bytes <= _LONG_BYTES:
                break
            self.ids = WordIds(_IDS)  # full: what is met again is learnt again
        if len(new) + len(new_long) > self.ids.room:
            self.ids = WordIds(len(new) + len(new_long))  # a text with so many
        for at in range(0, len(new), _AT_ONCE):
            part = new[at:at + _AT_ONCE]
            spelled = [data[a:b] for a, b in zip(begin[short[part]].tolist(), end[short[part]].tolist(), strict=True)]
            self.ids.add(low[part], high[part], *self._word_ids(spelled))
        for at in range(0, len(new_long), _AT_ONCE):
            part = new_long[at:at + _AT_ONCE]
            none = np.zeros(0, np.uint64)
            self.ids.long.update(zip(part, self.ids.add(none, none, *self._word_ids(part)).tolist(), strict=True))
            self.ids.long_bytes += sum(map(len, part))
        missing = number[short] < 0
        number[short[missing]] = self.ids.find(low[missing], high[missing])
        number[long] = [self.ids.long[w] for w in words]
        counts = self.ids.count[number]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids.ids[np.repeat(self.ids.start[number] - before[:-1], counts) + np.arange(before[-1])]
        stops = before[np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))]  # words begin before their text's end
        return ids, np.diff(stops, prepend=0)

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many ids each has)."""
        split = [[w.lower()] if w.isalpha() else self._parts(w) for w in words]
        flat = [p for s in split for p in s]
        coded = [p for p in flat if isinstance(p, bytes)]
        ids, counts = self.encode_pretokens(coded) if coded else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(coded) < len(flat):
            own = np.array([not isinstance(p, bytes) for p in flat])
            all_counts = np.ones(len(flat), np.int64)
            all_counts[~own] = counts
            all_ids, at = np.zeros(all_counts.sum(), np.int64), np.repeat(own, all_counts)
            all_ids[at], all_ids[~at] = [p for p in flat if not isinstance(p, bytes)], ids
            ids, counts = all_ids, all_counts
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(s) for s in split])]
        return ids, np.diff(ends, prepend=0)

    def _parts(self, word: bytes) -> list[bytes | int]:
        """A word's pre-tokens, and ids of special tokens."""
        parts: list[bytes | int] = []
        for w in self.words(word.decode("utf-8", "replace")):
            parts += [self.special[w]] if w in self.special else self.pretokens(w)
        return parts

    def _spelled(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[bytes, str, str]]:
        """Of each run of ids up to ``ends``: packed as 32-bit integers, in decimal, and as tokens."""
        packed, listed = ids.astype("<u4").tobytes(), ids.tolist()
        starts = np.concatenate([[0], ends[:-1]])
        cuts = [(packed, (4 * starts).tolist(), (4 * ends).tolist())]
        for names, sizes in ((self.decimal, self.decimal_size), (self.shown, self.shown_size)):
            place = np.concatenate([[0], np.cumsum(sizes[ids])])
            cuts.append((" ".join([names[i] for i in listed]), place[starts].tolist(), (place[ends] - 1).tolist()))
        parts = [[whole[a:b] for a, b in zip(first, last, strict=True)] for whole, first, last in cuts]
        return zip(*parts, strict=True)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tables of a vocabulary file, built once in a worker."""
    if path not in _loaded:
        gc.set_threshold(200_000, 50, 100)  # the cache makes no cycles, and walking it over and over takes longer than the work
        give_back()  # what earlier tasks used, before the tables are built
        _loaded[path] = WordBpe(path)
        give_back()
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    for ids, texts in text_chunks(batches, keep="bpe"):
        documents = [bpe.words(t.decode("utf-8", "replace")) for t in texts]
        bpe.learn(documents)
        known = bpe.cache
        out = []
        for d in documents:
            rows = [known[w] for w in d]
            out.append((" ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], pa.string()) for k in (0, 1))],
                                         names=["doc_id", "ids", "decoded"])


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text: its ids in decimal, joined by a space, and the
    text that they decode to (this vocabulary has no decoder: its tokens joined by a space).

    Null and empty texts and white space have no ids: both are the empty string.  Null ids of
    documents stay null; repeated rows are encoded each; an empty table gives an empty table.
    ``path`` names a word-level BPE file that all workers can read.
    """
    path = path or default_path()
    return documents_of(df, id_col, text_col).mapInArrow(
        lambda batches: _encoded(batches, path), "doc_id long, ids string, decoded string")


def decode_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): what the ids decode to."""
    path = path or default_path()

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {str(i): t for i, t in loaded(path).tokens.items()}
        for b in batches:
            texts = [" ".join([tokens[i] for i in (x or "").split()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), F.col("ids")).mapInArrow(decoded, "doc_id long, text string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"))
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.translate("ids", " ", "")) + 1)
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
