"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of its distinct shingles of ``SHINGLE`` words (64-bit hashes).  Its sketch has REGISTERS
registers of 16 bits.  A hash's first bits choose the register, which keeps the smallest of the remaining bits as
a leading-zero count and ten mantissa bits.  A register that no hash falls into takes the smallest value of a hash
function of its own over the whole set instead, so it agrees between two sets with the probability of their Jaccard
similarity too, and no band is made of empty registers.  Candidates are documents that agree in all registers of
a band.  Agreement of registers, corrected for the collisions that short registers must have, estimates the
similarity; pairs more than CUT standard errors below the threshold go, and the rest are confirmed on full sets.

Documents with equal sets collapse before any of that.  What is left goes in two steps, neither of which writes
the pairs of a group.  First every document names one partner: of the leads of its bands, the one it shares most
bands with (a band's lead is its member with the most company, which is the middle of a group of copies).  Those
links, one a document at most, are confirmed and give components.  Then the bands that still hold several
components are gone through: their members' sketches, in blocks, tell which members may be linked across
components, and the full sets of those, again in blocks, give the links, of which only the ones that join
something leave the task.  A pair that shares several bands is looked at in the first of them.  Components come
from rounds of large-star and small-star steps over tables in the shared folder.

A pair at exactly 0.75 shares no band with probability 5e-6 and is cut by the estimate with 1e-6; every pair
that shares a band and passes the cut is either confirmed or already in one component.

Null or empty texts and texts without words have empty sets and are linked with nothing.  Repeated rows are
equal sets: linked.  Null ids take part; a component's id is its smallest id that is not null.  Empty table:
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._store import REST, ROW, discard, keyed, original, releasing, written

SHINGLE = 5
REGISTERS, REGISTER_BITS = 128, 7
#: A register: leading zeros * 1024 + 10 mantissa bits.
MANTISSA = 10
#: Registers of a band; the bands cover all registers.
BAND = 4
BANDS = REGISTERS // BAND
#: Standard errors that an estimate may lie below the threshold.
CUT = 5.0
#: Partners of one document that are confirmed in one chunk.
CHUNK = 512
#: Members of a band whose sketches, and shingles whose sets, make a block of it.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 19
#: Members up to which the pairs of a band are compared at once.
FEW = 24
_ODD = T.mix(np.arange(1, REGISTERS + 1, dtype=T.U64) * T.U64(0x9E3779B97F4A7C15)) | T.U64(1)


def shingle_sets(part: T.Slice) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = T.Slice(part.first, T.LOWER[part.data], part.offsets)
    starts, ends, offsets = low.words(T.SPACES)
    words = low.word_hashes(starts, ends)
    grams = T.ngram_hashes(words, SHINGLE)
    for i in range(part.n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield T.mix(T.ngram_hashes(words[a:b], b - a) + T.U64(b - a))
        else:
            yield np.zeros(0, T.U64)


def _least(values: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The smallest value of each register's own hash function over all values."""
    out = np.empty(len(register), T.U64)
    step = max(1, (1 << 17) // len(values))
    for k in range(0, len(register), step):
        own = values[None, :] * _ODD[register[k : k + step], None]
        own ^= own >> T.U64(32)
        own *= T.U64(0x94D049BB133111EB)
        out[k : k + step] = own.min(axis=1)
    return out


def registers(values: np.ndarray) -> np.ndarray:
    """Sketch of a set of sorted hashes; all zeros for the empty set."""
    if not len(values):
        return np.zeros(REGISTERS, np.uint16)
    top = (values >> T.U64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(top, prepend=-1))
    low = np.empty(REGISTERS, T.U64)
    low[top[first]] = values[first] << T.U64(REGISTER_BITS)
    bare = np.ones(REGISTERS, bool)
    bare[top[first]] = False
    bare = np.flatnonzero(bare)
    if len(bare):
        low[bare] = _least(values, bare)
    mantissa, exponent = np.frexp((low >> T.U64(11)).astype(np.float64) + 0.5)
    part = np.minimum((mantissa * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint16)
    return ((53 - exponent).clip(0, 62).astype(np.uint16) << np.uint16(MANTISSA)) | part


def estimates(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from the number of registers that agree.

    The minima of two unrelated sets fall into one cell of relative width 0.72 / 2**MANTISSA (the mean over a
    binade) with that width times a * b / (a + b)**2.
    """
    chance = 0.72 / (1 << MANTISSA) * n_a * n_b / np.maximum(n_a + n_b, 1).astype(float) ** 2
    return (agree / REGISTERS - chance) / (1 - chance)


def may_link(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs can have the similarity, by their sizes and by the estimate."""
    error = np.sqrt(threshold * (1 - threshold) / REGISTERS)
    sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    return sizes & (estimates(agree, n_a, n_b) >= threshold - CUT * error)


SKETCHES = f"{ROW} long, n_shingles long, print_a long, print_b long, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Size, fingerprint and registers of each document (_row, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.text_slices(batch.column(1)):
                n, a, b = (np.zeros(part.n, t) for t in (np.int64, T.U64, T.U64))
                codes = np.zeros((part.n, REGISTERS), np.uint16)
                for i, values in enumerate(shingle_sets(part)):
                    if len(values):
                        n[i], codes[i] = len(values), registers(values)
                        a[i] = np.bitwise_xor.reduce(T.mix(values))
                        b[i] = np.add.reduce(T.mix(values ^ T.U64(0x2545F4914F6CDD1D)))
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), part.n, [None, pa.py_buffer(codes.tobytes())])
                columns = [batch.column(0).slice(part.first, part.n), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), sketch.cast(pa.binary())]
                yield pa.record_batch(columns, [ROW, "n_shingles", "print_a", "print_b", "sketch"])

    return docs.mapInArrow(releasing(rows), SKETCHES)


def band_members(sets: DataFrame) -> DataFrame:
    """(key, _row, size): the bands that more than one of the sets has; a key's last five bits are the band's number."""
    width = 2 * BAND
    keys = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sketch, b * {width} + 1, {width})) & -{BANDS}L | CAST(b AS BIGINT))"
    keys = sets.select(ROW, F.explode(F.expr(keys)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return keys.join(shared, "key").select("key", ROW, "size")


def _codes(column) -> np.ndarray:
    """The registers of a column of sketches, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint16)
    start = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[start : start + 2 * REGISTERS * len(column)].view(np.uint16).reshape(-1, REGISTERS)


def nominated(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(lead, other): for each member the lead that it shares most bands with, if their sketches allow a link."""
    score = members.groupBy(ROW).agg(F.sum("size").alias("score"))
    placed = members.join(score, ROW)
    lead = placed.groupBy("key").agg(F.max(F.struct("score", (-F.col(ROW)).alias("lead"))).alias("best"))
    asked = members.join(lead, "key").select(ROW, (-F.col("best.lead")).alias("lead"), "best.score").where(F.col(ROW) != F.col("lead"))
    asked = asked.groupBy(ROW, "lead").agg(F.count(F.lit(1)).alias("bands"), F.max("score").alias("score"))
    best = asked.groupBy(ROW).agg(F.max(F.struct("bands", "score", (-F.col("lead")).alias("lead"))).alias("best")).select(F.col(ROW).alias("other"), (-F.col("best.lead")).alias("lead"))
    of = lambda x: sets.select(F.col(ROW).alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_codes(batch.column(4)) == _codes(batch.column(5))).sum(axis=1)
            keep = may_link(agree, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold)
            yield batch.select([0, 1]).filter(pa.array(keep))

    # Both sides grow with the input, so the joins are by shuffle at any size.
    both = best.join(of("other").hint("merge"), "other").join(of("lead").hint("merge"), "lead")
    return both.select("lead", "other", "n_lead", "n_other", "sketch_lead", "sketch_other").mapInArrow(releasing(rows), "lead long, other long")


def _confirm_rows(threshold: float):
    """Rows sorted by (lead, chunk, lead first): the links whose sets are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, np.zeros(0, T.U64)
        for batch in batches:
            lead, chunk, ids = (batch.column(c).to_numpy() for c in ("lead", "chunk", ROW))
            out = []
            for part in T.text_slices(batch.column("text")):
                for i, values in enumerate(shingle_sets(part), part.first):
                    if ids[i] == lead[i]:
                        now, base = (lead[i], chunk[i]), values
                        continue
                    assert now == (lead[i], chunk[i])
                    common = len(np.intersect1d(base, values, assume_unique=True))
                    if len(values) and common >= threshold * (len(base) + len(values) - common) - 1e-9:
                        out.append((lead[i], ids[i]))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["src", "dst"])

    return rows


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: float, rows: int | None = None) -> DataFrame:
    """(src, dst): the pairs, about ``rows``, whose full sets have the similarity."""
    pairs = written(pairs, "pairs", rows)
    chunks = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    part = F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int")
    asked = pairs.join(chunks, "lead").select("lead", part.alias("chunk"), F.col("other").alias(ROW))
    leads = chunks.select("lead", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("lead").alias(ROW))
    wanted = asked.unionByName(leads).groupBy(ROW).agg(F.collect_list(F.struct("lead", "chunk")).alias("to"))
    texts = docs.select(ROW, "text").join(wanted.hint("merge"), ROW).select(ROW, "text", F.explode("to").alias("t")).select("t.lead", "t.chunk", ROW, "text")
    texts = texts.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", F.col(ROW) != F.col("lead"))
    links = written(texts.mapInArrow(releasing(_confirm_rows(threshold)), "src long, dst long"), "links")
    discard(pairs)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, comp), written: the smallest node that each linked node can reach."""
    edges = written(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "edges", links.count())
    rows, mark = edges.count(), None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, written(small, "edges", rows)
        discard(before)
        found = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        rows, mark = found[0], found
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = written(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components", 2 * rows)
    discard(edges)
    return out


class Bucket:
    """Members of a band, or of two blocks of one, that are in several components."""

    def __init__(self, band: int, crossing: bool, block: np.ndarray, n: np.ndarray, codes: np.ndarray, comps: np.ndarray, threshold: float):
        self.band, self.crossing, self.block, self.n, self.codes, self.threshold = band, crossing, block, n, codes, threshold
        _, self.comps = np.unique(comps, return_inverse=True)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may be linked with member i and share no earlier band with it."""
        others = others[self.comps[others] != self.comps[i]]
        if self.crossing:
            others = others[self.block[others] != self.block[i]]
        others = others[np.minimum(self.n[i], self.n[others]) >= self.threshold * np.maximum(self.n[i], self.n[others]) - 1e-9]
        same = self.codes[others] == self.codes[i]
        keep = may_link(same.sum(axis=1), self.n[i], self.n[others], self.threshold)
        earlier = same[keep][:, : self.band * BAND].reshape(int(keep.sum()), self.band, BAND).all(axis=2).any(axis=1)
        return others[keep][~earlier]

    def outside(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member that isn't in the largest component, and those it is to be compared with: every pair once."""
        largest = np.bincount(self.comps).argmax()
        inside = np.flatnonzero(self.comps == largest)
        out = np.flatnonzero(self.comps != largest)
        for k, i in enumerate(out.tolist()):
            yield i, np.concatenate((inside, out[k + 1 :]))

    def active(self) -> np.ndarray:
        """Which members may be linked with one of another component."""
        flags = np.zeros(len(self.n), bool)
        for i, others in self.outside():
            near = self.near(i, others)
            if len(near):
                flags[i] = flags[near] = True
        return flags

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links between components, confirmed on full sets, as long as they join something."""
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(names), bool)
        for i, others in self.outside():
            near = self.near(i, others)
            own = numbers[offsets[i] : offsets[i + 1]]
            mine[own] = True
            for k in range(0, len(near), 256):
                some = near[k : k + 256]
                some = some[self.comps[some] != self.comps[i]]
                common = np.array([np.count_nonzero(mine[numbers[offsets[j] : offsets[j + 1]]]) for j in some.tolist()], np.int64)
                for j in some[common >= self.threshold * (self.n[i] + self.n[some] - common) - 1e-9].tolist():
                    if self.comps[j] != self.comps[i]:
                        self.comps[self.comps == self.comps[j]] = self.comps[i]
                        yield i, j
            mine[own] = False


PLACE = ["key", "p", "q"]


def _edges(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where the groups of equal key, p and q begin, and the end."""
    turn = np.zeros(max(0, table.num_rows - 1), bool)
    for name in PLACE:
        values = table.column(name).to_numpy()
        turn |= values[1:] != values[:-1]
    return np.concatenate(([0], np.flatnonzero(turn) + 1, [table.num_rows]))


def _whole(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by key, p and q in tables of ``limit`` rows or more that never cut a group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_edges(table)[-2])
            if cut:
                yield table.slice(0, cut)
            held = pa.Table.from_batches([b for b in table.slice(cut).to_batches() if b.num_rows]).to_batches()
            size = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _few_active(starts: np.ndarray, g: int, band, n, codes, comps, threshold: float, flags: np.ndarray) -> None:
    """``Bucket.active`` for all groups of g members, many at a time."""
    a, b = np.triu_indices(g, 1)
    step = max(1, 8_000 // len(a))
    for k in range(0, len(starts), step):
        some = starts[k : k + step, None]
        i, j = (some + a).ravel(), (some + b).ravel()
        ok = (comps[i] != comps[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[ok], j[ok]
        same = codes[i] == codes[j]
        earlier = same.reshape(len(i), BANDS, BAND).all(axis=2) & (np.arange(BANDS) < band[i][:, None])
        ok = may_link(same.sum(axis=1), n[i], n[j], threshold) & ~earlier.any(axis=1)
        flags[i[ok]] = flags[j[ok]] = True


def _columns(table: pa.Table) -> tuple:
    key, block, n, comps = (table.column(c).to_numpy() for c in ("key", "block", "n_shingles", "comp"))
    crossing = table.column("p").to_numpy() != table.column("q").to_numpy()
    return (key & (BANDS - 1)).astype(np.int64), crossing, block, n, _codes(table.column("sketch")), comps


def _active_rows(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches):
        for table in _whole(batches, 4096):
            band, crossing, block, n, codes, comps = _columns(table)
            edges = _edges(table)
            size = np.diff(edges)
            flags = np.zeros(table.num_rows, bool)
            first = edges[:-1]
            few = (size <= FEW) & ~crossing[first]
            for g in np.unique(size[few & (size > 1)]).tolist():
                _few_active(first[few & (size == g)], g, band, n, codes, comps, threshold, flags)
            for lo, hi in zip(first[~few].tolist(), edges[1:][~few].tolist(), strict=True):
                at = slice(lo, hi)
                flags[at] |= Bucket(int(band[lo]), bool(crossing[lo]), block[at], n[at], codes[at], comps[at], threshold).active()
            if flags.any():
                yield from table.select(["key", ROW]).filter(pa.array(flags)).to_batches()

    return rows


def _link_rows(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["key", "p", "q", ROW, "block", "n_shingles", "sketch", "comp"]

    def joined(held: list[pa.RecordBatch], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks()
        band, crossing, block, n, codes, comps = _columns(table)
        found = list(Bucket(int(band[0]), bool(crossing[0]), block, n, codes, comps, threshold).links(sets))
        ids = table.column(ROW).to_numpy()
        return pa.record_batch([pa.array(ids[list(c)]) for c in zip(*found, strict=True)], ["src", "dst"]) if found else None

    def rows(batches):
        held: list[pa.RecordBatch] = []
        sets: list[np.ndarray] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [s for part in T.text_slices(batch.column("text")) for s in shingle_sets(part)]
            narrow = batch.select(names)
            edges = _edges(batch)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                place = tuple(batch.column(c)[lo].as_py() for c in PLACE)
                if held and place != now:
                    out = joined(held, sets)
                    if out is not None:
                        yield out
                    held, sets = [], []
                now = place
                held.append(narrow.slice(lo, hi - lo))
                sets += made[lo:hi]
        if held:
            out = joined(held, sets)
            if out is not None:
                yield out

    return rows


def _dealt(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` with p, q and block: each pair of blocks of a key has the members of both."""
    block = F.pmod(F.xxhash64(ROW), F.col("blocks")).cast("int")
    placed = members.join(blocks, "key").withColumn("block", block)
    each = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("p", F.least("block", "x")).withColumn("q", F.greatest("block", "x")).drop("x", "blocks")


def crossing_links(members: DataFrame, sets: DataFrame, comps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): links that join components, from all pairs of candidates that are in different ones."""
    placed = members.join(comps.withColumnRenamed("node", ROW), ROW, "left").select("key", ROW, F.coalesce("comp", ROW).alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("size")).where("a < b")
    several = several.select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = _dealt(placed, several).join(sets.select(ROW, "n_shingles", "sketch"), ROW)
    dealt = dealt.select("key", "p", "q", ROW, "block", "n_shingles", "sketch", "comp").repartition(*PLACE).sortWithinPartitions(*PLACE)
    active = written(dealt.mapInArrow(releasing(_active_rows(threshold)), f"key long, {ROW} long").distinct(), "active", members.count())
    held = active.join(comps.withColumnRenamed("node", ROW), ROW, "left").join(sets.select(ROW, "n_shingles"), ROW).select("key", ROW, F.coalesce("comp", ROW).alias("comp"), "n_shingles")
    blocks = held.groupBy("key").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    wanted = _dealt(held, blocks).groupBy(ROW, "n_shingles", "comp").agg(F.collect_list(F.struct("key", "p", "q", "block")).alias("to"))
    texts = wanted.join(sets.select(ROW, "sketch").hint("merge"), ROW).join(docs.select(ROW, "text").hint("merge"), ROW)
    texts = texts.select(ROW, "n_shingles", "comp", "sketch", "text", F.explode("to").alias("t")).select("t.*", ROW, "n_shingles", "sketch", "comp", "text")
    texts = texts.repartition(*PLACE).sortWithinPartitions(*PLACE)
    links = written(texts.mapInArrow(releasing(_link_rows(threshold)), "src long, dst long"), "links")
    discard(active)
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, n_shingles, component_id and kept, for every document.

    Documents are linked if their sets have at least the similarity; component_id is the smallest id that can
    be reached over links, itself included; one document of each component is kept, that with this id.
    """
    return _near_duplicates(keyed(docs, id_col, text_col), threshold)


def _near_duplicates(rows: DataFrame, threshold: float) -> DataFrame:
    made = written(sketches(rows.select(ROW, "text")), "sketches")
    prints = ["n_shingles", "print_a", "print_b"]
    sets = made.where("n_shingles > 0").groupBy(*prints).agg(F.min(F.struct(ROW, "sketch")).alias("s"))
    n = made.count()
    sets = written(sets.select(f"s.{ROW}", *prints, "s.sketch"), "sets", n)
    members = written(band_members(sets), "members", BANDS * n)
    links = confirmed(nominated(members, sets, threshold), rows, threshold, n)
    comps = components(links)
    more = crossing_links(members, sets, comps, rows, threshold)
    discard(members, comps)
    comps = components(links.unionByName(more))
    discard(links, more)

    same = sets.select(*prints, F.col(ROW).alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*prints, F.coalesce("comp", "rep").alias("comp"))
    group = made.select(ROW, *prints).join(same, prints, "left").select(ROW, "n_shingles", F.coalesce("comp", ROW).alias("comp"))
    named = rows.select(ROW, "doc_id").join(group, ROW)
    # The smallest id of each component, and the first row that has it.
    least = written(named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("m")), "least", n)
    out = named.join(least, "comp")
    return out.select(ROW, "doc_id", "n_shingles", F.col("m.doc_id").alias("component_id"), (F.col(ROW) == F.col(f"m.{ROW}")).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one of each component."""
    rows = keyed(docs, id_col, text_col, rest=True)
    gone = _near_duplicates(rows, threshold).where("not kept").select(ROW)
    return original(rows.select(ROW, "text", REST).join(gone, ROW, "left_anti"), docs, text_col)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(ROW)
