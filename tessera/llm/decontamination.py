"""Finding benchmark passages in training text with a positional inverted index.

``build_index`` writes the training postings as a table: one row a block of documents, with each term's sorted
positions in the block.  Terms are those of the benchmark (others can't be in a match), and the blocks spread
over the tasks, so no posting list is ever gathered in one place.  ``phrase_matches`` takes the global counts
of the terms from the index, starts in each block from an item's rarest terms, and intersects the lists of the
neighbouring terms, shifted by their offsets, until runs of the item's words are left that are long enough.
``proximity_matches`` finds the places where all distinct terms of a short item lie within a span.

The items are sent to every task in parts of at most PART_BYTES; each part is one pass over the index.

Null or empty texts have no words.  An item with fewer words than the window is one window; one without words
never occurs.  Items that repeat are items of their own; repeated document rows are documents of their own.
Empty tables give empty results or no hits.  Other columns are ignored, or passed on in ``_rest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._store import REST, ROW, keyed, original, quoted, releasing, written

#: Most bytes of item texts that go to every task at once.
PART_BYTES = 8 << 20
#: Bytes of text in a block of the index.
BLOCK_BYTES = 1 << 20
#: Most alignments that are compared at once.
STEP = 1 << 18


def _terms(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased in ASCII, and the index of each row's first."""
    low = T.Slice(part.first, T.LOWER[part.data], part.offsets)
    starts, ends, offsets = low.words(T.NON_ALNUM)
    return low.word_hashes(starts, ends), offsets


@dataclass
class Items:
    """Benchmark items as term numbers, end to end: item i has terms[offsets[i]:offsets[i + 1]]."""

    ids: list
    terms: np.ndarray
    offsets: np.ndarray
    vocabulary: np.ndarray  # sorted hashes; a term's number is its place

    @staticmethod
    def parse(rows: list) -> Items:
        column = pa.array([r[1] for r in rows], pa.string())
        hashes = [T.U64([])]
        lengths = []
        for part in T.text_slices(column):
            h, o = _terms(part)
            hashes.append(h)
            lengths += np.diff(o).tolist()
        flat = np.concatenate(hashes)
        vocabulary, terms = np.unique(flat, return_inverse=True)
        return Items([r[0] for r in rows], terms.astype(np.int64), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64), vocabulary)


def item_parts(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in parts that are small enough to send to every task."""
    held: list = []
    size = 0
    rows = items.select(quoted(items, id_col).cast("long"), quoted(items, text_col).cast("string")).toLocalIterator()
    for row in rows:
        n = len((row[1] or "").encode())
        if held and size + n > PART_BYTES:
            yield Items.parse(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield Items.parse(held)


INDEX = "rows array<long>, ids array<long>, lengths array<int>, terms array<int>, counts array<int>, positions array<int>"


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The stored postings of ``docs`` (_row, doc_id, text): blocks with the positions of each term of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in T.text_slices(batch.column(2), BLOCK_BYTES):
                hashes, offsets = _terms(part)
                if len(known):
                    number = np.searchsorted(known, hashes)
                    number[number == len(known)] = 0
                    at = np.flatnonzero(known[number] == hashes)
                    number = number[at]
                else:
                    at = number = np.zeros(0, np.int64)
                order = np.argsort(number.astype(np.int32), kind="stable")
                terms, counts = np.unique(number, return_counts=True)
                columns = [keys[part.first : part.first + part.n], np.diff(offsets).astype(np.int32), terms.astype(np.int32), counts.astype(np.int32), at[order].astype(np.int32)]
                kinds = [pa.int64(), *[pa.int32()] * 4]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.n], pa.int32()), batch.column(1).slice(part.first, part.n))
                yield pa.record_batch([lists[0], ids, *lists[1:]], ["rows", "ids", "lengths", "terms", "counts", "positions"])

    return written(docs.select(ROW, "doc_id", "text").mapInArrow(releasing(rows), INDEX), "postings")


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """How often each term of the vocabulary occurs in all blocks."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in pairs.toLocalIterator():
        counts[row[0]] = row[1]
    return counts


class Block:
    """One row of the index."""

    def __init__(self, rows, ids, lengths, terms, counts, positions, size: int):
        self.rows, self.ids, self.offsets = rows, ids, np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.pointer = np.zeros(size + 1, np.int64)
        self.pointer[terms + 1] = counts
        np.cumsum(self.pointer, out=self.pointer)
        self.positions = positions
        # The same postings by position, to look a shifted list up instead of merging it.
        self.term_at = np.full(int(self.offsets[-1]) + 2, -1, np.int64)
        self.term_at[positions] = np.repeat(terms, counts)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.pointer[term] : self.pointer[term + 1]]


def _starts_by_rarity(items: Items, counts: np.ndarray, window: int) -> np.ndarray:
    """Places in the items such that every window has one of them: for each window its rarest term's place."""
    out = []
    for i in range(len(items.ids)):
        lo, hi = items.offsets[i], items.offsets[i + 1]
        w = min(window, hi - lo)
        if w:
            cost = counts[items.terms[lo:hi]]
            views = np.lib.stride_tricks.sliding_window_view(cost, w)
            out.append(lo + np.unique(np.arange(len(views)) + views.argmin(axis=1)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _alignments(block: Block, items: Items, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, place) of each posting of each start term, some at a time."""
    n = block.pointer[items.terms[places] + 1] - block.pointer[items.terms[places]]
    places, n = places[n > 0], n[n > 0]
    edges = np.concatenate(([0], np.cumsum(n)))
    begun = 0
    while begun < len(places):
        end = max(begun + 1, int(np.searchsorted(edges, edges[begun] + STEP, side="right")) - 1)
        m = n[begun:end]
        place = np.repeat(places[begun:end], m)
        inside = np.arange(int(m.sum())) - np.repeat(edges[begun:end] - edges[begun], m)
        yield block.positions[block.pointer[items.terms[place]] + inside].astype(np.int64), place
        begun = end


def _extend(block: Block, items: Items, position: np.ndarray, place: np.ndarray, owner: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many neighbours on one side agree, up to ``most``, within the document and the item."""
    row = np.searchsorted(block.offsets, position, side="right") - 1
    if step > 0:
        room = np.minimum(block.offsets[row + 1] - position, items.offsets[owner + 1] - place) - 1
    else:
        room = np.minimum(position - block.offsets[row], place - items.offsets[owner])
    room = np.minimum(room, most)
    run = np.zeros(len(position), np.int64)
    live = np.flatnonzero(room > 0)
    for d in range(1, most + 1):
        live = live[room[live] >= d]
        live = live[block.term_at[position[live] + step * d] == items.terms[place[live] + step * d]]
        if not len(live):
            break
        run[live] = d
    return run


def block_matches(block: Block, items: Items, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, end position, item index) of the stretches of the block that item windows cover."""
    found = []
    owners = np.searchsorted(items.offsets, places, side="right") - 1
    owner_of = np.full(int(items.offsets[-1]) + 1, -1, np.int64)
    owner_of[places] = owners
    size = np.diff(items.offsets)
    for position, place in _alignments(block, items, places):
        owner = owner_of[place]
        need = np.minimum(window, size[owner])
        after = _extend(block, items, position, place, owner, 1, 1)
        before = _extend(block, items, position, place, owner, -1, 1)
        keep = (after + before + 1 >= np.minimum(need, 2))
        position, place, owner, need = position[keep], place[keep], owner[keep], need[keep]
        after = _extend(block, items, position, place, owner, 1, window - 1)
        before = _extend(block, items, position, place, owner, -1, window - 1)
        keep = after + before + 1 >= need
        found.append((position[keep] - before[keep], position[keep] + after[keep] + 1, owner[keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, lengths, terms, counts, positions = (batch.column(c)[i].values.to_numpy() for c in (0, 2, 3, 4, 5))
            yield Block(rows, batch.column(1)[i].values, lengths, terms.astype(np.int64), counts, positions, size)


MATCHES = f"{ROW} long, doc_id long, n_words long, spans array<array<long>>, items array<long>"


def phrase_matches(index: DataFrame, items: Items, window: int = 10) -> DataFrame:
    """(_row, doc_id, n_words, spans, items) for every document: stretches covered by item windows, items that occur."""
    places = _starts_by_rarity(items, term_counts(index, len(items.vocabulary)), window)
    sent = index.sparkSession.sparkContext.broadcast((items, places))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts = sent.value
        for block in _blocks(batches, len(held.vocabulary)):
            first, end, item = block_matches(block, held, starts, window)
            row = np.searchsorted(block.offsets, first, side="right") - 1
            spans: list = [[] for _ in block.rows]
            hits: list = [set() for _ in block.rows]
            for f, e, i, r in zip(first.tolist(), end.tolist(), item.tolist(), row.tolist(), strict=True):
                spans[r].append([f - int(block.offsets[r]), e - int(block.offsets[r])])
                hits[r].add(i)
            ids = [[held.ids[i] for i in sorted(h)] for h in hits]
            yield pa.record_batch([pa.array(block.rows), block.ids, pa.array(np.diff(block.offsets)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.int64()))], [ROW, "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(releasing(rows), MATCHES)


def proximity_matches(index: DataFrame, items: Items, span: int = 20) -> DataFrame:
    """(_row, item_id, first, last): for each document, every stretch of at most ``span`` words that has all
    distinct terms of an item, in any order, and no shorter such stretch in it."""
    counts = term_counts(index, len(items.vocabulary))
    sent = index.sparkSession.sparkContext.broadcast((items, counts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = sent.value
        for block in _blocks(batches, len(held.vocabulary)):
            out = []
            for i, name in enumerate(held.ids):
                terms = np.unique(held.terms[held.offsets[i] : held.offsets[i + 1]])
                terms = terms[np.argsort(seen[terms], kind="stable")]
                lists = [block.postings(t).astype(np.int64) for t in terms]
                if not lists or not all(len(x) for x in lists):
                    continue
                minimal: dict[tuple[int, int], int] = {}  # by row and last word: the latest start
                for start in np.unique(np.concatenate(lists)).tolist():  # a stretch begins at one of the terms
                    r = int(np.searchsorted(block.offsets, start, side="right")) - 1
                    nexts = []
                    for x in lists:
                        j = int(np.searchsorted(x, start))
                        if j == len(x) or x[j] >= min(start + span, block.offsets[r + 1]):
                            break
                        nexts.append(int(x[j]))
                    else:
                        minimal[r, max(nexts)] = start
                out += [(int(block.rows[r]), name, start - int(block.offsets[r]), last - int(block.offsets[r])) for (r, last), start in minimal.items()]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [ROW, "item_id", "first", "last"])

    return index.mapInArrow(rows, f"{ROW} long, item_id long, first long, last long")


def _digest(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    out = []
    for stretch, names in zip(spans, items, strict=True):
        reach = hit = 0
        for first, end in sorted((int(f), int(e)) for f, e in stretch):
            hit += max(0, end - max(first, reach))
            reach = max(reach, end)
        out.append((hit, len(names), hashlib.sha256(",".join(sorted(str(n) for n in names)).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """_row, doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every document."""
    return _contamination(keyed(docs, id_col, text_col), benchmark, window, item_id_col, item_text_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    rows = keyed(docs, id_col, text_col, rest=True)
    gone = _contamination(rows, benchmark, window, item_id_col, item_text_col).where("contaminated").select(ROW)
    return original(rows.select(ROW, "text", REST).join(gone, ROW, "left_anti"), docs, text_col)


def _contamination(rows: DataFrame, benchmark: DataFrame, window: int, item_id_col: str, item_text_col: str) -> DataFrame:
    parts = list(item_parts(benchmark, item_id_col, item_text_col)) or [Items.parse([])]
    found = None
    for part in parts:
        matches = phrase_matches(build_index(rows, part.vocabulary), part, window)
        found = matches if found is None else found.unionByName(matches)
    if len(parts) > 1:
        found = found.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    digest = F.pandas_udf(_digest, "n_hit long, n_items long, items_sha256 string")
    digests = found.select(ROW, "doc_id", "n_words", digest("spans", "items").alias("d"))
    return digests.select(ROW, "doc_id", "n_words", "d.*").select(ROW, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop(ROW)
