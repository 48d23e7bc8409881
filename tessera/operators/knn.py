"""Exact nearest neighbours in blocks, similarity graphs and principal components.

All-pairs distances are worked out block against block: rows are gathered in blocks of BLOCK vectors, and a block of
queries meets the candidates of a partition one block after the other, behind a screen (``tessera.operators.screen``).
Only the k best of a query leave the task, so what is shuffled grows with the rows and not with their pairs; memory is
two blocks and a partition of PART_BYTES of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators.screen import Best

BLOCK = 4096
#: Smallest block of queries, where there are few.
LEAST_BLOCK = 64
#: Differences worked out at once.
TILE = 1 << 18
#: Bytes of candidates a partition.
PART_BYTES = 64 << 20
#: Labelled rows that one share of the cliques has.
SHARE = 4096
METRICS = ("correlation", "cosine", "euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra", "braycurtis", "minkowski")


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of a to each of b; NaN where the metric isn't defined."""
    if metric not in METRICS:
        raise NotImplementedError(f"metric {metric}; there are {METRICS}")
    with np.errstate(all="ignore"):
        if metric in ("correlation", "cosine"):
            if metric == "correlation":
                a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
            norms = (np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
            a, b = (np.where(n > 1e-12, x / n, np.nan) for x, n in zip((a, b), norms, strict=True))
            return 1 - a @ b.T
        out = np.empty((len(a), len(b)))
        step = max(1, TILE // max(1, b.size))
        for i in range(0, len(a), step):
            rows = a[i : i + step, None, :]
            d = np.abs(b[None] - rows)
            if metric in ("euclidean", "sqeuclidean", "minkowski"):
                d = (d * d).sum(axis=2)
                out[i : i + step] = d if metric == "sqeuclidean" else np.sqrt(d)
            elif metric == "chebyshev":
                out[i : i + step] = d.max(axis=2)
            elif metric == "canberra":
                out[i : i + step] = np.nan_to_num(d / (np.abs(b[None]) + np.abs(rows))).sum(axis=2)
            else:
                out[i : i + step] = d.sum(axis=2) / (np.abs(b[None] + rows).sum(axis=2) if metric == "braycurtis" else 1)
        return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _spare(candidates: DataFrame, k: int) -> DataFrame:
    """Of candidates with equal vectors the k + 1 smallest ids; no others can be among the k best of any query."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank")


def _blocked(rows: DataFrame, n_blocks: int, parts: int) -> DataFrame:
    """(ids, v): blocks of at most BLOCK rows as bytes, dealt over so many partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held))
            return pa.record_batch([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "v"])

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                if n and n + part.num_rows > BLOCK:
                    yield block()
                    held, n = [], 0
                held.append((part.column(0).to_numpy(), vectors_of(part.column(1))))
                n += part.num_rows
        if n:
            yield block()

    return rows.repartition(n_blocks).mapInArrow(pack, "ids binary, v binary").repartition(parts)


def _sizes(rows: DataFrame) -> tuple[int, int]:
    return rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "correlation", threshold: float | None = None) -> DataFrame:
    """(src, dst, dist, rank): for each query (id, v) up to k other candidates, nearest first, ties to the smaller id.

    dist is rounded to 9 places before it is compared; distances above ``threshold`` and undefined ones are left out.
    """
    distances(np.ones((1, 2)), np.ones((1, 2)), metric)  # an unknown metric fails here
    limit = np.inf if threshold is None else threshold

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block of queries meets all candidates of the partition in a row; the state goes by blocks, should it not.
        asked: dict[int, Best] = {}
        for batch in batches:
            for q_ids, q, c_ids, c in zip(*(batch.column(j) for j in range(4))):
                q_ids, c_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, c_ids))
                if q_ids[0] not in asked:
                    asked[q_ids[0]] = Best(q_ids.copy(), np.frombuffer(q.as_buffer()).reshape(len(q_ids), -1).copy(), k, metric, limit)
                asked[q_ids[0]].meet(c_ids, np.frombuffer(c.as_buffer()).reshape(len(c_ids), -1))
        for best in asked.values():
            yield pa.record_batch([pa.array(x) for x in best.found()], ["src", "dst", "dist"])

    queries, candidates = (x.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda y: y.cast("double")).alias("v")) for x in (queries, candidates))
    candidates = _spare(candidates, k)
    (n_q, _), (n_c, width) = _sizes(queries), _sizes(candidates)
    # Blocks of queries enough for all cores; candidates in partitions of PART_BYTES, each of which leaves k of a query.
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    n_q = max(-(-n_q // BLOCK), min(4 * cores, n_q // LEAST_BLOCK), 1)
    parts = -(-8 * width * n_c // PART_BYTES) or 1
    asked, held = _blocked(queries, n_q, n_q), _blocked(candidates, -(-n_c // BLOCK) or 1, parts)
    pairs = asked.select(F.col("ids").alias("q_ids"), F.col("v").alias("q")).hint("shuffle_replicate_nl").crossJoin(held.select(F.col("ids").alias("c_ids"), F.col("v").alias("c")))
    found = pairs.mapInArrow(rows, "src long, dst long, dist double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))
    return ranked.where(F.col("rank") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst, each once, without self loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def from_matrix(spark: SparkSession, matrix, ids: list[int]) -> DataFrame:
    """(src, dst) of a square adjacency matrix, dense or sparse (with ``tocoo``), whose rows and columns are ``ids``."""
    if len(matrix.shape) != 2 or tuple(matrix.shape) != (len(ids), len(ids)):
        raise ValueError(f"the graph has shape {tuple(matrix.shape)}, but there are {len(ids)} rows")
    if hasattr(matrix, "tocoo"):
        held = matrix.tocoo()
        row, col = held.row[held.data != 0], held.col[held.data != 0]
    else:
        row, col = np.nonzero(np.asarray(matrix))
    names = np.asarray(ids, np.int64)
    return undirected(spark.createDataFrame(list(zip(names[row].tolist(), names[col].tolist(), strict=True)), "src long, dst long"))


def replica_cliques(rows: DataFrame) -> DataFrame:
    """(src, dst): every two rows of a label, the smaller id first.

    A label's rows meet in shares of some SHARE of them, so that a large label isn't one task.
    """
    labelled = rows.where("label is not null").select("label", "id")
    n = -(-labelled.count() // SHARE) or 1
    a = labelled.select("label", F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share"))
    b = labelled.select("label", F.col("id").alias("dst"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("share"))
    return a.join(b, ["label", "share"]).where("src < dst").select("src", "dst")


def out_of_atlas(rows: DataFrame, k: int, metric: str, threshold: float) -> DataFrame:
    """(label, src, dst, dist, rank): the k new rows nearest to each label's first row."""
    firsts = rows.where("label is not null").groupBy("label").agg(F.min_by(F.struct("id", "v"), "id").alias("f")).select("label", "f.id", "f.v")
    return nearest(firsts, rows.where("label is null"), k, metric, threshold).join(firsts.select(F.col("id").alias("src"), "label"), "src")


def graph_average(rows: DataFrame, k: int, k_out: int, metric: str, threshold: float) -> DataFrame:
    """Edges of (id, v, label): cliques of a label's replicas, k_out new rows for each label, k of all for new rows."""
    labelled, new = rows.where("label is not null"), rows.where("label is null")
    out = out_of_atlas(rows, k_out, metric, threshold).select("label", "dst")
    out = out.join(labelled.select("label", F.col("id").alias("src")), "label").select("src", "dst")
    # Cliques are between labelled rows, the others have a new one: only these can be there twice.
    return replica_cliques(rows).unionByName(undirected(out.unionByName(nearest(new, rows, k, metric, threshold).select("src", "dst"))))


def external_neighbours(rows: DataFrame, k: int, metric: str, threshold: float, mutual: bool = False) -> DataFrame:
    """(src, dst, dist, rank): up to k labelled rows for each new row; mutual ones only if asked."""
    labelled, new = rows.where("label is not null"), rows.where("label is null")
    found = nearest(new, labelled, k, metric, threshold)
    if mutual:
        back = nearest(labelled, new, k, metric, threshold).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        found = found.join(back, ["src", "dst"], "left_semi").select("src", "dst", "dist", "rank")
    return found


def graph_subsample(rows: DataFrame, k: int, metric: str, threshold: float, k_external: int = 0, threshold_external: float = 0.8, mutual: bool = False) -> DataFrame:
    """Edges of (id, v, label): k neighbours of every row, and k_external labelled ones of every new row."""
    edges = nearest(rows, rows, k, metric, threshold).select("src", "dst")
    if k_external:
        edges = edges.unionByName(external_neighbours(rows, k_external, metric, threshold_external, mutual).select("src", "dst"))
    return undirected(edges)


def covariance(rows: DataFrame, weight: str | None = None) -> tuple[np.ndarray, int]:
    """Covariance of the places of the vectors ``v``, by weight if one is named, and the number of rows.

    The Gramian is added up by partitions; only its places-by-places sum comes to the driver.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mass, sums, count = None, 0.0, None, 0
        for batch in batches:
            x = vectors_of(batch.column(1))
            if not len(x):
                continue
            g = batch.column(0).to_numpy()
            total = (x * g[:, None]).T @ x + (0 if total is None else total)
            sums = (x * g[:, None]).sum(axis=0) + (0 if sums is None else sums)
            mass, count = mass + g.sum(), count + len(x)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()]), pa.array([sums.tobytes()]), pa.array([mass]), pa.array([count])], ["g", "s", "w", "n"])

    parts = rows.select(w.alias("w"), "v").mapInArrow(gram, "g binary, s binary, w double, n long").collect()  # one matrix a partition
    if not parts:
        raise ValueError("no rows")
    width = len(np.frombuffer(parts[0]["s"]))
    mass, count = sum(p["w"] for p in parts), sum(p["n"] for p in parts)
    sums = sum(np.frombuffer(p["s"]) for p in parts)
    cov = (sum(np.frombuffer(p["g"]).reshape(width, width) for p in parts) - np.outer(sums, sums) / mass) / max(mass - 1, 1e-12)
    return cov, count


def principal_components(rows: DataFrame, n: int, weight: str | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores of standardised vectors ``v`` on their n leading components, the loadings and the eigenvalues.

    Each component's largest loading is positive.
    """
    names = [c for c in rows.columns if c != "v"]
    cov, count = covariance(rows, weight)
    if n > min(len(cov), count):
        raise ValueError(f"{n} components of {count} rows and {len(cov)} features")
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    sent = rows.sparkSession.sparkContext.broadcast(vectors)  # features times components

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column("v"))
            found = (x @ sent.value if len(x) else x).ravel()
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * n
            yield pa.record_batch([*[batch.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], [*names, "v"])

    schema = StructType([*rows.select(*names).schema.fields, StructField("v", ArrayType(DoubleType()))])
    return rows.select(*names, "v").mapInArrow(score, schema), vectors, values
