"""Token counts by dynamic programming shared over a trie of pre-tokens.

A text's pre-tokens are its words, each with the word-begin mark before it.  The distinct ones of a slice of
texts go into a trie; each node has the best unigram score of the string up to it, the number of tokens of the
best segmentation, and the pieces that may still go on, so the forward scores of a shared prefix are worked out
once.  The count at a word's last node is its token count, and a text's count is the sum over its words.  Words
of more than LONGEST characters hardly share prefixes; they go through the same programme one at a time.

Pieces and their scores come from a public vocabulary file, which is a parameter.  Characters without a piece
of their own fall back to their bytes, at a score below all pieces.  Tries are small and only the nodes of one
depth are held, so memory is bounded whatever the number of distinct words; no row leaves its task.

Null and empty texts have no words and no tokens.  Repeated rows give repeated results.  Empty table: empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _text as T
from tessera.llm._store import quoted, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text whose words share a trie, words of one trie, and characters of a word that goes into it.
SLICE = 1 << 21
MOST_WORDS = 200_000
LONGEST = 64
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = PIECES) -> dict[str, float]:
    """Pieces of a sentencepiece file with log-probabilities falling with their rank as 1 / (rank + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = list(dict.fromkeys(names))
    total = sum(1 / (r + 1) for r in range(len(names)))
    return {name: -math.log((r + 1) * total) for r, name in enumerate(names)}


class Counter:
    """Unigram token counts of words.

    Pieces are an automaton over characters: state 0 is the empty string, and a hash table holds the steps.
    A set of distinct words is a trie that is gone through by depth, all nodes of a depth at a time.  A node has
    the best score of the string up to it and the tokens of the best segmentation; its items are the pieces
    that have begun at an ancestor and may go on.  On equal scores the longest last piece wins.
    """

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.width = len(self.chars) + 1
        self.steps: dict[int, int] = {}  # state * width + character to state
        ends = [-math.inf]
        for piece, score in pieces.items():
            state = 0
            for ch in piece:
                state = self.steps.setdefault(state * self.width + self.chars[ch], len(ends))
                if state == len(ends):
                    ends.append(-math.inf)
            if state:
                ends[state] = score
        self.ends = np.array(ends)
        self.char_of = np.zeros(0x110000, np.int32)
        self.char_of[[ord(c) for c in self.chars]] = list(self.chars.values())
        self._build_table()

    def _build_table(self) -> None:
        """An open hash table of the steps: keys, states, and how many places from its own a key may be."""
        self.bits = max(10, (4 * len(self.steps)).bit_length())
        self.table = np.full((1 << self.bits) + 1, -1, np.int64)
        self.states = np.full((1 << self.bits) + 1, -1, np.int64)
        keys, states = (np.fromiter(x, np.int64, len(self.steps)) for x in (self.steps.keys(), self.steps.values()))
        place, self.probes = self._place(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.table[place] < 0)
            free = free[np.unique(place[free], return_index=True)[1]]
            self.table[place[free]], self.states[place[free]] = keys[free], states[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            keys, states, place = keys[left], states[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(T.U64) * T.U64(0x9E3779B97F4A7C15) >> T.U64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after each character, -1 where no piece goes on."""
        keys = states * self.width + chars
        place = self._place(keys)
        out = np.where(self.table[place] == keys, self.states[place], -1)
        rest = np.flatnonzero((out < 0) & (self.table[place] >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            place[rest] = (place[rest] + 1) & ((1 << self.bits) - 1)
            hit = self.table[place[rest]]
            out[rest[hit == keys[rest]]] = self.states[place[rest[hit == keys[rest]]]]
            rest = rest[(hit != keys[rest]) & (hit >= 0)]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word of a list without repeats."""
        out = np.zeros(len(words), np.int64)
        order = sorted((w, i) for i, w in enumerate(words) if len(w) <= LONGEST)
        if order:
            out[[i for _, i in order]] = self._trie_counts([w for w, _ in order])
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = self.count_long(w)
        return out

    def _trie_counts(self, words: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        out = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(length > 0)
        same = np.ones(len(words), bool)  # the word before has the same prefix
        same[:1] = False
        node = np.zeros(len(words), np.int64)
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        n_items, first_item = np.zeros(1, np.int64), np.zeros(1, np.int64)
        state, score, count = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)  # one more than there are
        for depth in range(int(length.max(initial=0))):
            code = np.zeros(len(words), np.uint32)
            code[alive] = codes[start[alive] + depth]
            here = length > depth
            same[1:] &= here[1:] & here[:-1] & (code[1:] == code[:-1])
            fresh = alive[~same[alive]]
            parent, char = node[fresh], self.char_of[code[fresh]].astype(np.int64)
            # The parent's items, then the piece that begins here.
            n = n_items[parent] + 1
            at = np.cumsum(n) - n
            child = np.repeat(np.arange(len(fresh)), n)
            source = np.arange(len(child)) + np.repeat(first_item[parent] - at, n)
            begins = at + n - 1
            source[begins] = len(state) - 1
            s, x, c = state[source], score[source], count[source]
            s[begins], x[begins], c[begins] = 0, best[parent], tokens[parent]
            s = self.step(s, char[child])
            reached = x + np.where(s < 0, -math.inf, self.ends[s])
            gained = c + 1
            bare = begins[reached[begins] == -math.inf]  # no piece of its own: its bytes
            if len(bare):
                code_of = code[fresh[child[bare]]]
                reached[bare] = x[bare] + self.unknown
                gained[bare] = c[bare] + 1 + (code_of > 0x7F) + (code_of > 0x7FF) + (code_of > 0xFFFF)
            best = np.maximum.reduceat(reached, at)
            top = np.flatnonzero(reached == best[child])
            top = top[np.diff(child[top], prepend=-1) > 0]  # the longest piece is the first
            tokens = gained[top]
            keep = np.flatnonzero(s >= 0)
            n_items = np.bincount(child[keep], minlength=len(fresh))
            first_item = np.cumsum(n_items) - n_items
            state, score, count = (np.append(v[keep], v.dtype.type(0)) for v in (s, x, c))
            node[alive] = np.cumsum(~same[alive]) - 1
            done = alive[length[alive] == depth + 1]
            out[done] = tokens[node[done]]
            alive = alive[length[alive] > depth + 1]
        return out

    def count_long(self, word: str) -> int:
        """The same for one word of any length, a character at a time and without keeping its nodes."""
        best, tokens, items = 0.0, 0, []
        for ch in word:
            char = self.chars.get(ch, 0)
            going, top, n = [], -math.inf, 0
            for state, score, count in (*items, (0, best, tokens)):
                after = self.steps.get(state * self.width + char)
                end = -math.inf if after is None else score + float(self.ends[after])
                gained = count + 1
                if not state and end == -math.inf:
                    end, gained = score + self.unknown, count + len(ch.encode("utf-8", "surrogatepass"))
                if end > top:
                    top, n = end, gained
                if after is not None:
                    going.append((after, score, count))
            best, tokens, items = top, n, going
        return tokens


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            for part in T.text_slices(batch.column(1), SLICE):
                starts, ends, offsets = part.words(T.SPACES)
                _, first, inverse = np.unique(part.word_hashes(starts, ends), return_index=True, return_inverse=True)
                raw = part.data.tobytes()
                counts = np.zeros(len(first), np.int64)
                for i in range(0, len(first), MOST_WORDS):
                    some = first[i : i + MOST_WORDS]
                    words = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    counts[i : i + MOST_WORDS] = counter.counts(words)
                sums = np.concatenate(([0], np.cumsum(counts[inverse])))
                yield pa.record_batch([batch.column(0).slice(part.first, part.n), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets]))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text")).mapInArrow(rows, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces())
