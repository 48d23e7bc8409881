"""Finding every window of W units (words or bytes) that occurs more than once, without comparing pairs.

Each window is filed under its *anchor*: the smallest hash of the runs of k units inside it.  Equal windows
have equal anchors, so a window can only repeat inside its anchor's group (minimiser partitioning, known from
k-mer counting).  The steps:

1. ``anchor_rows``: the anchors of every text, some 2 / (W - k + 2) per unit.
2. Anchors found once in all texts go: their windows can't repeat.
3. ``segment_rows``: for the others, the stretch of text that the windows under this anchor cover.  Equal
   segments under one anchor collapse to one row with a weight before anything is shuffled by anchor, so a
   passage that is in a third of all rows is one row for each map task.
4. An engine (suffix automaton or Burrows-Wheeler transform) gets whole anchor groups and tells which windows
   of each distinct segment repeat; every window is judged on the input.
5. The flagged windows go back to the rows they came from.

Anchors with more than ``HOT`` distinct segments would make one group too large for a task.  Their windows are
first counted one by one by a 64-bit hash, with map-side combination, and only those that occur twice or more
stay, in segments filed under anchor and window content, so a hot anchor's group splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._store import ROW, releasing, written


#: Distinct segments of one anchor above which its windows are filed one by one.
HOT = 20_000


@dataclass(frozen=True)
class Spec:
    """words: units are words, else bytes; window: W; gram: k; piece: most windows of a segment."""

    words: bool
    window: int
    gram: int
    piece: int


class Layout:
    """Units of a slice, their anchors and window minima."""

    def __init__(self, part: T.Slice, spec: Spec):
        self.part, self.spec = part, spec
        if spec.words:
            self.starts, self.ends, self.offsets = part.words(T.SPACES)
            hashes = part.word_hashes(self.starts, self.ends)
            self.sums, self.inverse = T.prefix_sums(hashes, T.WORD_BASE), T.WORD_INV
        else:
            self.offsets = part.offsets
            self.sums, self.inverse = T.prefix_sums(part.data.astype(T.U64) + T.U64(1), T.BASE), T.BASE_INV
        self.minima = np.zeros(0, T.U64)
        self.valid = np.zeros(0, bool)
        k, width = spec.gram, spec.window - spec.gram + 1
        units = len(self.sums) - 1
        if units >= spec.window:
            self.grams = T.mix((self.sums[k:] - self.sums[:-k]) * T.powers(self.inverse, units + 1)[: units + 1 - k])
            self.minima = T.sliding(self.grams, width)
            first, last = self.offsets[:-1], self.offsets[1:] - spec.window + 1
            long = last > first
            self.valid = T.covered(len(self.minima), first[long], last[long])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Row index and hash of each place that is the smallest of some window."""
        if not self.valid.any():
            return np.zeros(0, np.int64), np.zeros(0, T.U64)
        width = self.spec.window - self.spec.gram + 1
        held = np.zeros(len(self.grams) + width - 1, T.U64)
        held[width - 1 : width - 1 + len(self.minima)] = np.where(self.valid, self.minima, T.U64(0))
        at = np.flatnonzero(T.sliding(held, width, np.maximum) == self.grams)
        at = at[self.grams[at] > 0]
        return np.searchsorted(self.offsets, at, side="right") - 1, self.grams[at]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end window of each run of windows with one anchor in one row, and its row."""
        if not self.valid.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        change = np.ones(len(self.minima), bool)
        change[1:] = (self.minima[1:] != self.minima[:-1]) | (self.valid[1:] != self.valid[:-1])
        inner = self.offsets[:-1]
        change[inner[inner < len(change)]] = True
        first = np.flatnonzero(change)
        end = np.append(first[1:], len(change))
        keep = self.valid[first]
        first, end = first[keep], end[keep]
        return first, end, np.searchsorted(self.offsets, first, side="right") - 1

    def window_hashes(self) -> np.ndarray:
        w = self.spec.window
        return T.mix((self.sums[w:] - self.sums[:-w]) * T.powers(self.inverse, len(self.sums))[: len(self.sums) - w] + T.U64(w))

    def content(self, first: int, last: int) -> bytes:
        """Units first to last - 1; words are joined by one space."""
        if not self.spec.words:
            return self.part.data[first:last].tobytes()
        return b" ".join(self.part.data[self.starts[first] : self.ends[last - 1]].tobytes().split())


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == T.U64 else values.astype(np.int64))


def _paired(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    return T.mix(anchor + row.astype(T.U64) * T.U64(0xC2B2AE3D27D4EB4F))


def _anchor_rows(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in T.text_slices(batch.column(1)):
                row, anchor = Layout(part, spec).anchors()
                if len(row):  # one line a row and anchor, so a line that a text repeats doesn't count for more
                    _, first, n = np.unique(_paired(anchor, row), return_index=True, return_counts=True)
                    yield pa.record_batch([_long(keys[part.first + row[first]]), _long(anchor[first]), _long(n)], [ROW, "anchor", "n"])

    return rows


def _listed(part: T.Slice, lists: pa.Array, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which (row, anchor) pairs are in the rows' own lists."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    flat = lists.values.to_numpy().view(T.U64)
    lo, hi = offsets[part.first], offsets[part.first + part.n]
    owner = np.repeat(np.arange(part.n), np.diff(offsets[part.first : part.first + part.n + 1]))
    return np.isin(_paired(anchor, row), _paired(flat[lo:hi], owner))


def _segment_rows(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [ROW, "anchor", "start", "seg"]

    def rows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in T.text_slices(batch.column(1)):
                layout = Layout(part, spec)
                first, end, row = layout.runs()
                if not len(first):
                    continue
                anchor = layout.minima[first]
                keep = _listed(part, batch.column(2), row, anchor)
                out: list[tuple] = []
                for f, e, r, a in zip(first[keep].tolist(), end[keep].tolist(), row[keep].tolist(), anchor[keep].view(np.int64).tolist(), strict=True):
                    origin = int(layout.offsets[r])
                    for at in range(f, e, spec.piece):
                        out.append((int(keys[part.first + r]), a, at - origin, layout.content(at, min(at + spec.piece, e) + spec.window - 1)))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names)

    return rows


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by the column ``anchor``, in tables of about ``limit`` bytes that never cut a group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        turns = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        sizes = np.frombuffer(batch.column("seg").buffers()[1], np.int32)[batch.column("seg").offset : batch.column("seg").offset + batch.num_rows + 1]
        turns = ([0] if held and held[-1].column("anchor")[-1].as_py() != anchor[0] else []) + turns.tolist()
        begun = 0
        for turn in turns:
            if size + int(sizes[turn] - sizes[begun]) >= limit:
                if turn > begun:
                    held.append(batch.slice(begun, turn - begun))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, begun = [], 0, turn
        held.append(batch.slice(begun))
        size += int(sizes[-1] - sizes[begun])
    if held:
        yield pa.Table.from_batches(held)


Engine = Callable[[np.ndarray, list, np.ndarray], list]


def _engine_rows(engine: Engine, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """engine(group numbers, contents, weights) gives for each content the flags of its windows, or None for none."""

    def rows(batches):
        for table in whole_groups(batches, limit):
            anchor = table.column("anchor").to_numpy()
            group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
            flags = engine(group, table.column("seg").to_pylist(), table.column("weight").to_numpy())
            at, starts, ends = [], [], []
            for i, f in enumerate(flags):
                if f is not None and f.any():
                    s, e = T.spans(f)
                    at.append(i)
                    starts.append(s.astype(np.int32))
                    ends.append(e.astype(np.int32))
            if at:
                picked = table.select(["anchor", "seg_id"]).take(pa.array(at)).combine_chunks().to_batches()[0]
                yield pa.record_batch([picked.column(0), picked.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["anchor", "seg_id", "from", "to"])

    return rows


def _unit_windows(spec: Spec, seg: bytes) -> tuple[np.ndarray, list[bytes] | bytes]:
    """Hash of each window of a segment, and what its units are to be cut from."""
    layout = Layout(T.Slice(0, np.frombuffer(seg, np.uint8), np.array([0, len(seg)])), spec)
    return layout.window_hashes(), seg.split(b" ") if spec.words else seg


def _window_rows(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_row, start, offset, part): a number of its own for each window under its anchor."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, anchor, start = (batch.column(c)[i].as_py() for c in range(3))
                hashes, _ = _unit_windows(spec, batch.column(3)[i].as_py())
                own = T.mix(hashes ^ np.int64(anchor).view(T.U64))
                n = len(own)
                yield pa.record_batch([pa.array(np.full(n, row)), pa.array(np.full(n, start, np.int32)), pa.array(np.arange(n, dtype=np.int32)), _long(own)], [ROW, "start", "offset", "part"])

    return rows


def _single_rows(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each listed window of a segment as a segment of one window."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, start, seg, windows = (batch.column(c)[i].as_py() for c in range(4))
                units = seg.split(b" ") if spec.words else seg
                cut = [units[w["offset"] : w["offset"] + spec.window] for w in windows]
                contents = [b" ".join(c) for c in cut] if spec.words else cut
                yield pa.record_batch(
                    [pa.array([row] * len(cut), pa.int64()), pa.array([w["part"] for w in windows], pa.int64()), pa.array([start + w["offset"] for w in windows], pa.int32()), pa.array(contents, pa.binary())],
                    [ROW, "anchor", "start", "seg"],
                )

    return rows


def split_hot(segments: DataFrame, spec: Spec) -> DataFrame:
    """The segments, those under hot anchors replaced by their repeated windows, each under a number of its own."""
    hot = written(segments.select("anchor", "seg_id").distinct().groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    if hot.isEmpty():
        return segments
    held = segments.join(hot, "anchor", "left_semi")
    windows = held.select(ROW, "anchor", "start", "seg").mapInArrow(_window_rows(spec), f"{ROW} long, start int, offset int, part long")
    again = windows.groupBy("part").count().where("count > 1").select("part")
    listed = windows.join(again, "part").groupBy(ROW, "start").agg(F.collect_list(F.struct("offset", "part")).alias("windows"))
    # A window's start is in one segment of its row only, so (_row, start) finds the segment.
    singles = held.select(ROW, "start", "seg").join(listed, [ROW, "start"]).mapInArrow(_single_rows(spec), f"{ROW} long, anchor long, start int, seg binary")
    cool = segments.join(hot, "anchor", "left_anti").select(ROW, "anchor", "start", "seg", "seg_id")
    return written(cool.unionByName(singles.withColumn("seg_id", F.xxhash64("seg"))), "segments")


def repeated_windows(docs: DataFrame, spec: Spec, engine: Engine, limit: int) -> DataFrame:
    """(_row, spans): for each row with repeated windows, structs of start, from and to.

    Windows ``start + from[i]`` to ``start + to[i] - 1`` of the row repeat.  ``docs`` has _row and text.
    """
    texts = docs.select(ROW, "text")
    found = texts.mapInArrow(releasing(_anchor_rows(spec)), f"{ROW} long, anchor long, n long")
    repeated = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    lists = found.select(ROW, "anchor").join(repeated, "anchor").groupBy(ROW).agg(F.collect_list("anchor").alias("anchors"))
    segments = written(
        texts.join(lists, ROW).select(ROW, "text", "anchors").mapInArrow(releasing(_segment_rows(spec)), f"{ROW} long, anchor long, start int, seg binary").withColumn("seg_id", F.xxhash64("seg")),
        "segments",
    )
    segments = split_hot(segments, spec)
    distinct = segments.groupBy("anchor", "seg_id", "seg").agg(F.count(F.lit(1)).alias("weight"))
    flags = distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(releasing(_engine_rows(engine, limit)), "anchor long, seg_id long, from array<int>, to array<int>")
    return segments.select(ROW, "anchor", "start", "seg_id").join(flags, ["anchor", "seg_id"]).groupBy(ROW).agg(F.collect_list(F.struct("start", "from", "to")).alias("spans"))


def unit_flags(spans: list | None, units: int, window: int) -> np.ndarray:
    """Which units of a row the windows in ``spans`` cover."""
    if not spans:
        return np.zeros(units, bool)
    starts = np.concatenate([np.asarray(s["from"], np.int64) + s["start"] for s in spans])
    ends = np.concatenate([np.asarray(s["to"], np.int64) + s["start"] for s in spans]) - 1 + window
    return T.covered(units, starts, np.minimum(ends, units))
