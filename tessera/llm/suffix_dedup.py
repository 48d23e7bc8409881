"""Removal of byte strings that occur elsewhere, by a Burrows-Wheeler transform built column by column.

Texts are cut into segments by anchor (see ``_segments``), so a 400-byte string can only repeat inside one
group of segments.  For each bounded collection of groups the transform is built as for multi-document
indexes: every round inserts one symbol of each segment, from the last to the first, at the place that the
transform so far gives it.  A symbol is a word with the white space byte that ends it, so a segment takes some
90 rounds instead of 600; symbols are numbered in the order of their bytes, so the order of suffixes is that of
their bytes.  The same columns then give the common prefixes of neighbours, one symbol deeper each round, and
the bytes of the first symbols that differ complete them.

The common prefixes decide.  A window begins with the rest of a symbol; two windows are equal if these rests are
equal and the suffixes after them have a common prefix of what the window still lacks.  Among windows with equal
rests, in the order of the suffixes after them, a window repeats if that holds for one of its two neighbours,
whose common prefix is the smallest between their places.  Windows of equal segments repeat by themselves.

The collections are a few hundred kilobytes, so the arrays that the published algorithm keeps in sequential
external files are read and rewritten in order in memory; nothing goes to a machine's own disk.

Nulls are empty texts: no bytes, nothing removed, the hash of the empty string.  Repeated rows count as
documents of their own.  Empty table: empty result.  Other columns are ignored, or passed on by
``without_repeated_bytes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import _text as T
from tessera.llm._segments import Spec, repeated_windows, unit_flags
from tessera.llm._store import REST, ROW, keyed, original, releasing

#: Bytes of whole groups that one transform is built for, if no group is larger.
COLLECTION_BYTES = 1 << 18
#: Most bytes of a symbol; where words are longer, symbols end after further bytes.
LONGEST = 64
#: Symbols end after these bytes, if no word is longer than LONGEST.
ENDS = np.zeros(256, bool)
ENDS[[0x20, *range(0x09, 0x0E)]] = True


class ColumnIndex:
    """All suffixes of a collection of symbol sequences, in order.

    ``first``: symbol that a suffix starts with; ``tail``: place of the suffix without it, or -1 for the empty
    one.  Sorted by (first, tail), that is the transform sorted by symbol: entry r is the r-th occurrence that
    the last-to-first mapping leads to.  ``bwt``: the symbol before each suffix, -1 at a start.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        self.symbols, self.offsets = symbols, offsets
        lengths = np.diff(offsets)
        self.first = np.zeros(0, np.int32)
        self.tail = np.zeros(0, np.int32)
        self.bwt = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int32)  # start of each suffix, by place
        place = np.full(len(lengths), -1, np.int32)  # of each sequence's last inserted suffix
        for column in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= column)
            start = offsets[live + 1] - column
            self._insert(live, start, symbols[start], place)

    def _insert(self, live: np.ndarray, start: np.ndarray, symbol: np.ndarray, place: np.ndarray) -> None:
        n, m = len(self.first), len(live)
        tail = place[live]
        had = tail >= 0
        self.bwt[tail[had]] = symbol[had]
        order = np.lexsort((tail, symbol))
        symbol, tail, start, live = symbol[order], tail[order], start[order], live[order]
        # Where (symbol, tail) comes in: by symbol first, then by tail among the suffixes that start with it.
        low, high = np.searchsorted(self.first, symbol, side="left"), np.searchsorted(self.first, symbol, side="right")
        where = _places(self.tail, low, high, tail)
        fresh = where + np.arange(m)
        moved = np.ones(n + m, bool)
        moved[fresh] = False
        old = np.flatnonzero(moved)  # new place of each old one

        def merged(have: np.ndarray, add: np.ndarray) -> np.ndarray:
            out = np.empty(n + m, np.int32)
            out[old] = have
            out[fresh] = add
            return out

        renamed = np.append(old, -1).astype(np.int32)  # -1 stays -1
        self.tail = merged(renamed[self.tail], renamed[tail])
        self.first = merged(self.first, symbol)
        self.at = merged(self.at, start)
        self.bwt = merged(self.bwt, np.full(m, -1, np.int32))
        idle = place >= 0
        place[idle] = renamed[place[idle]]
        place[live] = fresh

    def common(self, most: int) -> np.ndarray:
        """How many symbols each suffix shares with the one before it, up to ``most``; 0 for the first.

        Each round goes one symbol deeper: two neighbours that begin alike share one symbol more than the
        suffixes without that symbol do, between whose places no pair may have parted before.
        """
        n = len(self.first)
        depth = np.zeros(n, np.int32)
        parted = np.ones(n, bool)
        parted[1:] = self.first[1:] != self.first[:-1]
        live = np.flatnonzero(~parted)
        for _ in range(most):
            if not len(live):
                break
            depth[live] += 1
            number = np.cumsum(parted)
            a, b = self.tail[live - 1], self.tail[live]
            more = (a >= 0) & (b >= 0) & (number[a] == number[b])
            parted[live[~more]] = True
            live = live[more]
        return depth


def _places(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search of each wanted value in its own sorted stretch low:high of ``values``: the first larger."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    while True:
        live = low < high
        if not live.any():
            return low
        middle = (low + high) // 2
        right = live & (values[np.minimum(middle, len(values) - 1)] <= wanted)
        low = np.where(right, middle + 1, low)
        high = np.where(live & ~right, middle, high)


def _symbols(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Start of each symbol, their numbers, the symbols in order, and the index of each segment's first symbol.

    A symbol ends after a byte of ENDS, at the end of its segment, and, until none is longer than ``longest``,
    after the byte that is most frequent in the longer ones.  Which byte ends a symbol doesn't depend on what is
    before it, so equal stretches are cut alike.
    """
    ends = ENDS.copy()
    while True:
        begins = np.zeros(len(data), bool)
        begins[1:] = ends[data[:-1]]
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        size = np.diff(np.append(starts, len(data)))
        if size.max(initial=0) <= longest:
            break
        over = data[np.repeat(size > longest, size)]
        ends[np.bincount(over[~ends[over]], minlength=256).argmax()] = True
    blob, edges = data.tobytes(), np.append(starts, len(data)).tolist()
    words = [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    types = sorted(set(words))
    number = {w: i for i, w in enumerate(types)}
    return starts, np.fromiter((number[w] for w in words), np.int64, len(words)), types, np.searchsorted(starts, offsets)


def common_bytes(index: ColumnIndex, data: np.ndarray, starts: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, counted beyond whole symbols, up to ``window``."""
    n = len(index.at)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    depth = index.common(window)[1:].astype(np.int64)
    edges = np.append(starts, len(data))
    last = first[np.searchsorted(first, index.at, side="right")]  # end of each suffix's segment
    a, b = index.at[:-1] + depth, index.at[1:] + depth
    shared = edges[b] - edges[index.at[1:]]
    size = np.minimum(np.where(a < last[:-1], edges[np.minimum(a + 1, len(starts))] - edges[a], 0), np.where(b < last[1:], edges[np.minimum(b + 1, len(starts))] - edges[b], 0))
    x, y = edges[a], edges[b]
    live = np.flatnonzero((size > 0) & (shared < window))
    k = 0
    while len(live):
        live = live[data[x[live] + k] == data[y[live] + k]]
        shared[live] += 1
        k += 1
        live = live[size[live] > k]
    out[1:] = np.minimum(shared, window)
    return out


class Minima:
    """The smallest of any stretch of values, by stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            have, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(have[:-step], have[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest of values[low:high], each at least one long."""
        out = np.empty(len(low), self.levels[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for d in np.unique(level).tolist():
            at = np.flatnonzero(level == d)
            values = self.levels[d]
            out[at] = np.minimum(values[low[at]], values[high[at] - (1 << d)])
        return out


def _engine(window: int):
    def judge(group: np.ndarray, contents: list, weights: np.ndarray) -> list:
        flags: list = [None] * len(contents)
        edges = np.flatnonzero(np.diff(group)) + 1
        mixed: list[tuple[int, list[int]]] = []
        for members in np.split(np.arange(len(contents)), edges):
            if len(members) == 1 and weights[members[0]] > 1:  # equal documents: one insertion stands for all
                flags[members[0]] = np.ones(len(contents[members[0]]) - window + 1, bool)
            else:
                rounds = max(len(contents[i].split()) for i in members)
                mixed.append((rounds, members.tolist()))
        mixed.sort()  # groups of like length together: every round then inserts nearly everywhere
        collection: list[int] = []
        size = 0
        for k, (_, members) in enumerate(mixed):
            collection += members
            size += sum(len(contents[i]) for i in members)
            if size >= COLLECTION_BYTES or k == len(mixed) - 1:
                for i, f in zip(collection, repeated([contents[i] for i in collection], weights[collection], window), strict=True):
                    flags[i] = f
                collection, size = [], 0
        return flags

    return judge


def repeated(contents: list[bytes], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each of the contents, which of its windows occur more than once, by weight, in all of them."""
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in contents]))).astype(np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts, symbols, types, first = _symbols(data, offsets, min(LONGEST, window))
    index = ColumnIndex(symbols, first)
    minima = Minima(common_bytes(index, data, starts, first, window))
    place = np.empty(len(symbols) + 1, np.int64)
    place[index.at] = np.arange(len(symbols))
    place[-1] = 0

    # Each window: the rest of the symbol that it begins in, and the suffix after that.
    valid = T.covered(len(data), offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1]))
    at = np.flatnonzero(valid)
    inside = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    symbol = inside[at]
    names: dict[bytes, int] = {}
    rests = np.array([names.setdefault(t[o:], len(names)) for t in types for o in range(len(t))], np.int64)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in types])))
    rest = rests[begin[symbols[symbol]] + at - starts[symbol]]
    after = place[symbol + 1]
    lacks = window - (np.append(starts, len(data))[symbol + 1] - at)

    order = np.argsort(rest * (len(symbols) + 1) + after, kind="stable")
    rest, after, lacks = rest[order], after[order], lacks[order]
    same = rest[1:] == rest[:-1]
    # A window that lacks nothing after its first symbol is equal to all with that rest.
    open_ = np.flatnonzero(same & (lacks[1:] > 0))
    same[open_] = minima.least(after[open_] + 1, after[open_ + 1] + 1) >= lacks[open_ + 1]
    found = np.zeros(len(data) + 1, bool)
    found[at[order[:-1][same]]] = found[at[order[1:][same]]] = True
    owner = np.repeat(weights > 1, np.diff(offsets))
    found[:-1] |= valid & owner
    return [found[offsets[i] : max(offsets[i], offsets[i + 1] - window + 1)] for i in range(len(contents))]


def _long_runs(gone: np.ndarray, data: np.ndarray, window: int, words: int) -> np.ndarray:
    """``gone`` without the runs that are shorter than ``window`` bytes and hold fewer than ``words`` whole words."""
    starts, ends = T.spans(gone)
    word_starts, word_ends = T.spans(~ENDS[data])
    held = np.searchsorted(word_ends, ends, side="right") - np.searchsorted(word_starts, starts, side="left")
    keep = (ends - starts >= window) | (held >= words)
    return T.covered(len(data), starts[keep], ends[keep])


def _result_rows(window: int, words: int | None, searched: int, rest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            for part in T.text_slices(batch.column("text")):
                n_removed, n_spans, digests, kept_texts = [], [], [], []
                for i in range(part.n):
                    data = part.data[part.offsets[i] : part.offsets[i + 1]]
                    gone = unit_flags(spans[part.first + i].as_py(), len(data), searched)
                    if words is not None and gone.any():
                        gone = _long_runs(gone, data, window, words)
                    kept = (data[~gone] if gone.any() else data).tobytes()
                    n_removed.append(int(gone.sum()))
                    n_spans.append(len(T.spans(gone)[0]))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode("utf-8", "ignore") if rest and batch.column("text")[part.first + i].is_valid else None)
                columns = [ids.slice(part.first, part.n), pa.array(np.diff(part.offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if rest:
                    columns += [pa.array(kept_texts, pa.string()), batch.column(REST).slice(part.first, part.n)]
                    names += ["kept_text", REST]
                yield pa.record_batch(columns, names)

    return rows


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _found(rows: DataFrame, window: int, words: int | None) -> tuple[DataFrame, int]:
    """``rows`` (_row, doc_id, text [, _rest]) with the spans that repeat, and the length of the strings searched."""
    searched = window if words is None else max(1, min(window, 2 * words - 1))
    spec = Spec(words=False, window=searched, gram=max(1, min(24, searched // 4)), piece=2 * searched)
    return rows.join(repeated_windows(rows, spec, _engine(searched), 4 << 20), ROW, "left"), searched


def remove_repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """Each document without the bytes covered by a ``window``-byte string that also starts anywhere else.

    With ``words``, repeated passages of so many words go too, however few bytes they have: strings as short as
    the shortest such passage (words of one byte) are searched, and of the stretches that they cover, those of
    ``window`` bytes or ``words`` whole words go.  A stretch may join passages that repeat in different places.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256.
    """
    found, searched = _found(keyed(docs, id_col, text_col), window, words)
    return found.select("doc_id", "text", "spans").mapInArrow(releasing(_result_rows(window, words, searched, False)), RESULT)


def without_repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with the texts that ``remove_repeated_bytes`` leaves, without the pieces of a character cut in two.

    Rows that nothing is left of go; rows without text stay.  ``length_col`` names a column that gets the new
    number of characters, where it isn't null; the other columns are as they were.
    """
    rows = keyed(docs, id_col, text_col, rest=True)
    found, searched = _found(rows, window, words)
    schema = StructType.fromDDL(RESULT + ", kept_text string").add(rows.schema[REST])
    kept = found.select("doc_id", "text", "spans", REST).mapInArrow(releasing(_result_rows(window, words, searched, True)), schema)
    kept = kept.where("n_bytes = 0 or n_removed < n_bytes")
    instead = {}
    if length_col is not None and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        had = F.col(f"{REST}.c{docs.columns.index(length_col)}")
        instead[length_col] = F.when(had.isNotNull(), F.char_length("kept_text").cast(kind))
    return original(kept, docs, text_col, F.col("kept_text"), **instead)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
