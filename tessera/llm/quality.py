"""Quality scores from compression with class dictionaries.

Two zstandard dictionaries are built from labelled text, one of good and one of bad documents.  A text is
compressed in blocks of BLOCK bytes with each; the difference of the two total sizes, divided by the larger, is
negative where the bad dictionary fits better.  A logistic curve fitted on labelled documents that the
dictionaries haven't seen turns it, with the text's own compressibility, into a score from 0 to 1.

The fit uses at most ``fit_rows`` labelled documents and ``fit_bytes`` bytes of them, half of them of
either label, those whose ids have the smallest hashes; everything else covers all documents, whole.  Rows with crc32(id as text) mod 4 = 2 are held
out and never used for the fit.

Null texts are empty texts.  Empty texts get the score of their features like any other.  Labels that are null
or neither 0 nor 1 are left out, and an id with both labels too.  Without both labels to fit on, every score is
the share of good labels, (good + 1) / (all + 2).  Null ids are not held out.  Repeated rows get equal scores.
Empty table: empty result.  Other columns are passed on by ``with_scores``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm._store import quoted, releasing, small_batches

BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 32 << 10


@dataclass
class Model:
    """Dictionaries as bytes, and the logistic curve; without dictionaries every score is ``prior``."""

    good: bytes = b""
    bad: bytes = b""
    trained: bool = True
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float = 0.5

    def compressors(self) -> tuple:
        out = []
        for data in (self.good, self.bad, None):
            if data is None:
                out.append(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False))
                continue
            kind = zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
        return tuple(out)

    def scores(self, texts: list[bytes], compressors: tuple) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.prior)
        x = (np.array([features(t, compressors) for t in texts]).reshape(-1, 2) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -50, 50)))


def features(text: bytes, compressors: tuple) -> tuple[float, float]:
    """Normalised difference of the sizes with either dictionary, and size without one over length."""
    good, bad, plain = compressors
    a = b = 0
    for i in range(0, max(1, len(text)), BLOCK):
        block = text[i : i + BLOCK]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - a) / max(a, b), len(plain.compress(text)) / (len(text) + 1)


def _dictionary(lines: list[bytes]) -> tuple[bytes, bool]:
    samples = [b"".join(lines[i : i + 8]) for i in range(0, len(lines), 8)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(lines)[: 4 * DICTIONARY_BYTES] or b"\n", False


def fit(rows: list[tuple[bytes, int]], sizes: tuple[float, float] | None = None) -> Model:
    """A model of (text, label) rows: dictionaries from every other row of a label, the curve from the rest.

    sizes: how many rows of label 0 and 1 there are in all, where these are a sample with other shares.
    """
    labels = [y for _, y in rows]
    if len(set(labels)) < 2 or min(labels.count(0), labels.count(1)) < 4:
        return Model(prior=(sum(labels) + 1) / (len(labels) + 2))
    turn = [0, 0]
    build: list[dict] = [{}, {}]
    curve = []
    for text, y in rows:
        turn[y] += 1
        if turn[y] % 2:
            build[y].update(dict.fromkeys(text.split(b"\n")))
        else:
            curve.append((text, y))
    shared = build[0].keys() & build[1].keys()  # lines of both classes tell nothing
    own = [[x + b"\n" for x in sorted(b - shared, key=hash_of)] for b in (build[0].keys(), build[1].keys())]
    (bad, trained_bad), (good, trained_good) = (_dictionary(lines) for lines in own)
    trained = trained_bad and trained_good
    if not trained:
        bad, good = (b"".join(lines)[: 4 * DICTIONARY_BYTES] or b"\n" for lines in own)
    model = Model(good, bad, trained)
    compressors = model.compressors()
    x = np.array([features(t, compressors) for t, _ in curve])
    y = np.array([y for _, y in curve], float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - model.mean) / model.scale, np.ones(len(x))))
    share = np.array(sizes or (1, 1), float) / np.bincount(y.astype(int), minlength=2) if sizes else np.ones(2)
    share = share / share.mean()
    each = share[y.astype(int)]
    w = np.zeros(3)
    for _ in range(60):  # Newton's steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        hessian = (z * (each * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(3)
        w -= np.linalg.solve(hessian, z.T @ (each * (p - y)) + 1e-2 * w)
    model.weights = w
    return model


def hash_of(line: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line)


def fitting(lengths: list[int], labels: list[int], most: int) -> list[bool]:
    """Which texts to take, in order, for ``most`` bytes: half for each label; a text that doesn't fit is skipped."""
    left = {0: most // 2, 1: most - most // 2}
    taken = []
    for n, y in zip(lengths, labels, strict=True):
        taken.append(n <= left[y])
        left[y] -= n * taken[-1]
    return taken


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = 2500, fit_bytes: int = 10 << 20, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> Model:
    small_batches(docs.sparkSession)
    known = labels.select(quoted(labels, label_id).cast("long").alias("id"), quoted(labels, label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    texts = docs.select(quoted(docs, id_col).cast("long").alias("id"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).alias("text"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    order = [F.xxhash64("id"), F.col("id")]
    halves = [known.where(F.col("y") == y).orderBy(*order).limit(fit_rows // 2).select("id", "y") for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # fit_rows at most: it can be broadcast
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        encoded = [t.encode() for t in pdf["text"]]
        within = fitting([len(t) for t in encoded], pdf["y"].tolist(), fit_bytes)
        rows = [(t, int(y)) for t, y, w in zip(encoded, pdf["y"], within, strict=True) if w]
        return pd.DataFrame({"model": [pickle.dumps(fit(rows, (sizes.get(0, 0), sizes.get(1, 0))))]})

    # fit_rows texts at most, in one task; the driver gets the model only.
    made = found.select(F.lit(0).alias("g"), F.xxhash64("id").alias("h"), "id", "y", "text").groupBy("g").applyInPandas(kernel, "model binary").collect()
    return pickle.loads(bytes(made[0][0])) if made else Model()


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(_rest, score): the rows of ``docs``, all columns in the struct _rest, and their scores."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("_rest"), F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        compressors = held.compressors() if held.good else ()
        for batch in batches:
            scores = held.scores([t.as_buffer().to_pybytes() for t in batch.column(1)], compressors)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["_rest", "score"])

    return packed.mapInArrow(releasing(rows), StructType([packed.schema["_rest"], StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, **fit_options)
    narrow = docs.select(quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        compressors = held.compressors() if held.good else ()
        for batch in batches:
            scores = held.scores([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)], compressors)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = narrow.mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels)
