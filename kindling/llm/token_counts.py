"""Token counts by dynamic programming over a trie of distinct pre-tokens (5).

A unigram model takes, of all ways to cut a pre-token into vocabulary pieces, the one of highest
total log-probability.  Its forward scores depend on the prefix alone, so the distinct pre-tokens
of a chunk go into one trie and each node is scored once, whatever the number of words below it;
the node where a word ends has the word's count.  Documents add up their words' counts.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindling.llm.common import HashTable, documents_of, table, text_chunks

_WORDS, _CODE = 150_000, 0x110000
#: How much less likely a byte that stands for an unknown character is than the rarest piece.
_UNKNOWN_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranked_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with log-probabilities by Zipf's law of their rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = np.log((1.0 / np.arange(1, len(names) + 1)).sum())
    return {p: float(-np.log(r) - total) for r, p in enumerate(names, 1)}


class TrieCounter:
    """Best cuts of words into ``pieces``, each word after the mark of a word's start."""

    def __init__(self, pieces: dict[str, float], mark: str = "▁"):
        self.mark = mark
        self.unknown = min(pieces.values()) - _UNKNOWN_PENALTY
        step: dict[int, int] = {}
        ends, states = {}, 1
        for p, score in pieces.items():
            state = 0
            for c in reversed(p):
                key = state * _CODE + ord(c)
                if key not in step:
                    step[key], states = states, states + 1
                state = step[key]
            ends[state] = score
        self.step = HashTable(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))
        self.score = np.full(states, np.nan)
        self.score[list(ends)] = list(ends.values())
        self.cache: dict[str, tuple[int, float]] = {}

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(tokens, score) of each word's best cut (of equal scores the one of fewest tokens), and the trie's nodes."""
        marked = [self.mark + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(lengths) - lengths
        # node 0 is the root; a level's nodes have numbers that follow the level's above
        parent, letter, best, tokens = [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        node, alive, depth, nodes = np.zeros(len(words), np.int64), np.arange(len(words)), 0, 1
        up, sign, top, used = parent[0], letter[0], best[0], tokens[0]
        room = 1
        while True:
            alive = alive[lengths[alive] > depth]
            if not len(alive):
                break
            key, back = np.unique(node[alive] * _CODE + code[start[alive] + depth], return_inverse=True)
            node[alive] = nodes + back
            if nodes + len(key) > room:  # grow by doubling
                room = max(2 * room, nodes + len(key))
                up, sign, top, used = (np.resize(x, room) for x in (up, sign, top, used))
            new = slice(nodes, nodes + len(key))
            up[new], sign[new] = key // _CODE, key % _CODE
            self._forward(new, up, sign, top, used)
            nodes += len(key)
            depth += 1
        return used[node], top[node], nodes

    def _forward(self, new: slice, up: np.ndarray, sign: np.ndarray, top: np.ndarray, used: np.ndarray) -> None:
        letter = sign[new]
        size = 1 + (letter > 0x7F) + (letter > 0x7FF) + (letter > 0xFFFF)  # bytes of the letter as UTF-8
        best, count = top[up[new]] + size * self.unknown, used[up[new]] + size
        which, at, state = np.arange(len(letter)), np.arange(new.start, new.stop), np.zeros(len(letter), np.int64)
        while len(which):
            state = self.step.get(state * _CODE + sign[at]).astype(np.int64)
            on = state >= 0
            which, state, at = which[on], state[on], up[at[on]]
            score, n = top[at] + self.score[state], used[at] + 1
            better = (score > best[which]) | (score == best[which]) & (n < count[which])  # no piece here: not a number
            best[which[better]], count[which[better]] = score[better], n[better]
            on = at > 0
            which, state, at = which[on], state[on], at[on]
        top[new], used[new] = best, count

    def learn(self, documents: list[list[str]]) -> None:
        if len(self.cache) > _WORDS:
            self.cache.clear()
        new = list(set().union(*documents).difference(self.cache))
        for i in range(0, len(new), 16_384):
            words = new[i:i + 16_384]
            tokens, score, _ = self.count(words)
            self.cache.update(zip(words, zip(tokens.tolist(), score.tolist(), strict=True), strict=True))


_loaded: dict[str, TrieCounter] = {}


def _counted(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _loaded:
        gc.set_threshold(200_000, 50, 100)  # the cache makes no cycles
        _loaded[path] = TrieCounter(ranked_pieces(path))
    counter = _loaded[path]
    for ids, texts in text_chunks(batches, keep="token_counts"):
        documents = [t.decode("utf-8", "replace").split() for t in texts]
        counter.learn(documents)
        known, out = counter.cache, []
        for d in documents:
            rows = [known[w] for w in d]
            out.append((len(d), sum([r[0] for r in rows]), sum([r[1] for r in rows])))
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))],
            names=["doc_id", "n_pretokens", "n_tokens", "score"])


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every whole text: its words between white space, the
    pieces of their best cuts, and the sum of these cuts' log-probabilities.

    Null, empty and blank texts have 0 of each.  A character in no piece counts as its UTF-8 bytes.
    Repeated rows are counted each; an empty table gives an empty table.
    """
    path = path or default_path()
    return documents_of(df, id_col, text_col).mapInArrow(
        lambda batches: _counted(batches, path), "doc_id long, n_pretokens long, n_tokens long, score double")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
