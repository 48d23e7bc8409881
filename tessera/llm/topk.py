"""Exact top-k search by distributed histogram selection.

Every query is scored against every row.  Each round adds up a histogram of each query's scores over all rows
and narrows the interval that holds the query's k-th score to one bin; when the interval is one score wide, a
last pass keeps the scores that reach it.  Rows that tie at the k-th score are cut to the k smallest ids in
each task already, so a vector that is there a million times doesn't make a million rows.

Queries go in blocks of QUERY_BLOCK, each one pass over the rows a round; a block is what is broadcast, so its
size is bounded, and a histogram that leaves a task has at most k filled bins a query: bins below a task's own
k-th score can't hold the global one.

Scores are integer inner products.  Where the components are small enough they come from float64 products,
which are then exact, otherwise from int64 ones.  Vectors that are null or have null or non-finite components
take no part; vectors of another length than the query's don't match it.  Rows with a null id take no part.
Repeated ids are rows of their own: each is a candidate for the others.  Empty tables give empty results.
A score of 2**62 or more, or its negative, is an OverflowError instead of a long that has wrapped around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._store import new_folder, quoted, written

QUERY_BLOCK = 2048
BINS = 256
ROWS_AT_ONCE = 2048
WINNERS = "query_id long, query long, vec_id long, score long"


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row key, id and integer matrix of each run of vectors of one length."""
    lists = batch.column("v")
    lengths = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
    flat = lists.flatten().to_numpy()
    ends = np.concatenate(([0], np.cumsum(lengths)))
    keys, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        for i in range(0, len(at), ROWS_AT_ONCE):
            some = at[i : i + ROWS_AT_ONCE]
            yield keys[some], ids[some], flat[ends[some][:, None] + np.arange(width)]


def products(queries: np.ndarray, rows: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Inner products as int64; those of pairs outside ``use`` may be anything."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most >= 2**62 and (np.abs(queries.astype(float) @ rows.astype(float).T)[use] >= 2**62).any():
        raise OverflowError("the inner product of two vectors doesn't fit the range of scores, 2**62")
    return queries @ rows.T


class Queries:
    """A block of queries with the interval, low to low + width * BINS - 1, that each k-th score is in."""

    def __init__(self, keys, ids, vectors, low, width, above):
        self.keys, self.ids, self.vectors, self.low, self.width, self.above = keys, ids, vectors, low, width, above


def _histogram_rows(sent, k: int):
    """(query, bin, n): how many scores of a query fall in a bin; the last bin also has those above it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        counts = np.zeros((len(q.keys), BINS), np.int64)
        for batch in batches:
            for keys, _, matrix in _vectors(batch):
                if matrix.shape[1] != q.vectors.shape[1]:
                    continue
                others = q.keys[:, None] != keys[None, :]
                scores = products(q.vectors, matrix, others)
                bins = np.minimum((scores - q.low[:, None]) // q.width[:, None], BINS - 1)
                use = (bins >= 0) & others
                row, col = np.nonzero(use)
                counts += np.bincount(row * BINS + bins[row, col], minlength=counts.size).reshape(counts.shape)
        reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or above
        useful = (counts > 0) & (reach - counts < k)
        row, col = np.nonzero(useful)
        if len(row):
            yield pa.record_batch([pa.array(row), pa.array(col), pa.array(counts[row, col])], ["query", "bin", "n"])

    return rows


def _winner_rows(sent, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.keys)
        for batch in batches:
            for keys, ids, matrix in _vectors(batch):
                if matrix.shape[1] != q.vectors.shape[1]:
                    continue
                others = q.keys[:, None] != keys[None, :]
                scores = products(q.vectors, matrix, others)
                use = (scores >= q.low[:, None]) & others
                for i in np.flatnonzero(use.any(axis=1)).tolist():
                    s, d = np.concatenate((held[i][0], scores[i, use[i]])), np.concatenate((held[i][1], ids[use[i]]))
                    if len(s) > k:
                        best = np.lexsort((d, -s))[:k]
                        s, d = s[best], d[best]
                    held[i] = (s, d)
        n = [len(s) for s, _ in held]
        if sum(n):
            yield pa.record_batch([pa.array(np.repeat(q.ids, n)), pa.array(np.repeat(q.keys, n)), pa.array(np.concatenate([d for _, d in held])), pa.array(np.concatenate([s for s, _ in held]))], ["query_id", "query", "vec_id", "score"])

    return rows


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best other rows, ties to the smaller id.

    ``is_query`` marks the rows that are queries; components count as floor(scale * x).
    """
    vector = quoted(rows, vector_col)
    whole = rows.where(vector.isNotNull() & quoted(rows, id_col).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    prepared = written(
        whole.select(F.monotonically_increasing_id().alias("row"), quoted(rows, id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")),
        "vectors",
    )
    spark = rows.sparkSession
    found = new_folder(spark, "winners")  # of all blocks, so the plan is as small for many blocks as for one
    spark.createDataFrame([], WINNERS).write.parquet(found)
    for block in _query_blocks(prepared.where("asks").select("row", "id", "v")):
        _write_winners(prepared.select("row", "id", "v"), block, k, found)
    ranked = spark.read.schema(WINNERS).parquet(found).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_blocks(queries: DataFrame) -> Iterator[Queries]:
    held: dict[int, list] = {}
    for row in queries.toLocalIterator():
        some = held.setdefault(len(row["v"]), [])
        some.append(row)
        if len(some) == QUERY_BLOCK:
            yield _query_block(some)
            held[len(row["v"])] = []
    for some in held.values():
        if some:
            yield _query_block(some)


def _query_block(rows: list) -> Queries:
    vectors = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
    n = len(rows)
    return Queries(np.array([r["row"] for r in rows], np.int64), np.array([r["id"] for r in rows], np.int64), vectors, np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64))


def _write_winners(rows: DataFrame, q: Queries, k: int, path: str) -> None:
    """Adds the best rows of the block's queries to the files below ``path``."""
    context = rows.sparkSession.sparkContext
    width = q.vectors.shape[1]
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    longest = rows.where(F.size("v") == width).agg(F.max(size)).first()[0] or 0.0
    # |q . x| <= max|q| * sum|x|; the interval starts with all scores that can be.
    bound = np.minimum(np.abs(q.vectors.astype(float)).max(axis=1, initial=0) * longest + 1, 2.0**62)
    q.low = -bound.astype(np.int64)
    q.width = -(-2 * bound.astype(np.int64) // BINS) + 1
    while True:
        sent = context.broadcast(q)
        found = rows.mapInArrow(_histogram_rows(sent, k), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(q.keys), BINS), np.int64)
        for row in found.toLocalIterator():  # at most BINS numbers a query of the block
            counts[row["query"], row["bin"]] = row["n"]
        sent.destroy()
        reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        inside = (reach >= k).sum(axis=1) - 1  # the highest bin with k scores in it or above; -1: fewer than k rows
        done = q.width == 1
        short = inside < 0
        q.low = np.where(short, q.low, q.low + inside * q.width)
        if (done | short).all():
            break
        # The bin becomes the interval; what is above it still counts, in the last bin.
        q.width = np.where(short | done, q.width, np.maximum(-(-q.width // (BINS - 1)), 1))
    sent = context.broadcast(q)
    rows.mapInArrow(_winner_rows(sent, k), WINNERS).write.mode("append").parquet(path)
    sent.destroy()


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 100 == 0)
