"""Removal of word sequences that occur elsewhere, by suffix automata of reference shards.

The reference is the collection itself.  It is cut into shards by anchor (see ``_segments``), each shard gets
one suffix automaton over words, and the shard's segments are streamed through it for matching statistics:
the state that holds the last ``window`` words tells how often they occur in the shard, which is how often
they occur anywhere.  The automata are sent to the tasks that need them rather than broadcast to all: the
reference grows with the data, so broadcasting it, or streaming every text past every shard, would not.
``remove_matches`` is the broadcast form, for a reference of bounded size.

Nulls and texts without words: no words, nothing removed, the hash of the empty string.  Texts shorter than
the window: nothing removed.  Repeated rows count as documents of their own.  Empty table: empty result.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._segments import Spec, repeated_windows, unit_flags
from tessera.llm._store import ROW, keyed, quoted

#: Most bytes of a reference that ``remove_matches`` sends to every task.
BROADCAST_BYTES = 32 << 20


class Automaton:
    """Suffix automaton of word sequences; ``count`` has how often each state's words occur, by weight."""

    __slots__ = ("next", "link", "length", "count")

    def __init__(self, sequences: list[list], weights: list[int]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for words, weight in zip(sequences, weights, strict=True):
            self._insert(words, weight)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _insert(self, words: list, weight: int) -> None:
        edges, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            known = edges[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += weight
                continue
            if known is not None:  # the words are there inside a longer state: split it
                last = self._split(last, w, known)
                count[last] += weight
                continue
            new = len(length)
            edges.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p != -1 and w not in edges[p]:
                edges[p][w] = new
                p = link[p]
            if p != -1:
                q = edges[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w, q: int) -> int:
        edges, link = self.next, self.link
        copy = len(self.length)
        edges.append(dict(edges[q]))
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        link.append(link[q])
        link[q] = copy
        while p != -1 and edges[p].get(w) == q:
            edges[p][w] = copy
            p = link[p]
        return copy

    def occurrences(self, words: list, window: int) -> np.ndarray:
        """How often each window of ``words`` occurs in the automaton's sequences (0: it doesn't)."""
        edges, link, length, count = self.next, self.link, self.length, self.count
        out = np.zeros(max(0, len(words) - window + 1), np.int64)
        state = matched = 0
        for i, w in enumerate(words):
            step = edges[state].get(w)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = edges[state].get(w)
            if step is None:
                matched = 0
                continue
            state = step
            matched += 1
            while length[link[state]] >= window:
                state = link[state]
            if matched >= window:
                matched = min(matched, length[state])
                out[i - window + 1] = count[state]
        return out


def _engine(window: int):
    def judge(group: np.ndarray, contents: list, weights: np.ndarray) -> list:
        flags: list = [None] * len(contents)
        edges = np.flatnonzero(np.diff(group)) + 1
        shard: list[int] = []
        size = 0
        for members in np.split(np.arange(len(contents)), edges):
            if len(members) == 1 and weights[members[0]] > 1:  # one sequence, there more than once: an automaton of one path
                flags[members[0]] = np.ones(contents[members[0]].count(b" ") + 2 - window, bool)
                continue
            shard += members.tolist()
            size += sum(len(contents[i]) for i in members)
            if size > 1 << 19:
                _judge_shard(shard, contents, weights, window, flags)
                shard, size = [], 0
        if shard:
            _judge_shard(shard, contents, weights, window, flags)
        return flags

    return judge


def _judge_shard(shard: list[int], contents: list, weights: np.ndarray, window: int, flags: list) -> None:
    sequences = [contents[i].split(b" ") for i in shard]
    automaton = Automaton(sequences, [int(weights[i]) for i in shard])
    for i, words in zip(shard, sequences, strict=True):
        flags[i] = automaton.occurrences(words, window) > 1


def _result_rows(window: int, text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            for part in T.text_slices(batch.column("text")):
                starts, ends, offsets = part.words(T.SPACES)
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for i in range(part.n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    words = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().split()
                    gone = unit_flags(spans[part.first + i].as_py(), b - a, window)
                    if gone.any():
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if text else None)
                columns = [ids.slice(part.first, part.n), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.record_batch(columns + [pa.array(kept_texts, pa.string())] * text, names + ["kept_text"] * text)

    return rows


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Each document without the words covered by a ``window``-word sequence that also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (kept words joined by
    one space).
    """
    rows = keyed(docs, id_col, text_col)
    spec = Spec(words=True, window=window, gram=max(1, min(8, window // 3)), piece=256)
    spans = repeated_windows(rows, spec, _engine(window), 2 << 20)
    return rows.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInArrow(_result_rows(window, with_text), RESULT + ", kept_text string" * with_text)


def remove_matches(docs: DataFrame, reference: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """Each document without the words covered by a ``window``-word sequence of the reference.

    The reference is broadcast as texts in shards of ``shard_bytes``; each task builds one shard's automaton
    at a time and streams its documents through it.  Beyond BROADCAST_BYTES the call is refused: use
    ``remove_repeats`` over both tables then.  Returns the columns of ``remove_repeats``.
    """
    held = reference.select(quoted(reference, text_col).cast("string").alias("text")).where("text is not null")
    size = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        raise ValueError(f"the reference has {size} bytes; at most {BROADCAST_BYTES} can be broadcast")
    shards: list[list[bytes]] = [[]]
    room = shard_bytes
    for row in held.toLocalIterator():
        text = row[0].encode()
        if room < len(text) and shards[-1]:
            shards.append([])
            room = shard_bytes
        shards[-1].append(text)
        room -= len(text)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    result = _result_rows(window, False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            hits = [np.zeros(max(0, len(w) - window + 1), bool) for w in texts]
            for shard in sent.value:
                sequences = [t.split() for t in shard]
                automaton = Automaton(sequences, [1] * len(sequences))
                for words, hit in zip(texts, hits, strict=True):
                    hit |= automaton.occurrences(words, window) > 0
            spans = []
            for hit in hits:
                s, e = T.spans(hit)
                spans.append([{"start": 0, "from": s.tolist(), "to": e.tolist()}] if len(s) else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("from", pa.list_(pa.int32())), ("to", pa.list_(pa.int32()))]))
            yield from result(iter([pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(spans, kind)], ["doc_id", "text", "spans"])]))

    return keyed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(rows, RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
