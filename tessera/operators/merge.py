"""Normalisation, logs, standardisation and dense vectors of the merged matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def coverage(expr: DataFrame) -> DataFrame:
    """(obs, coverage): sum of each observation's values."""
    return expr.groupBy("obs").agg(F.sum("value").alias("coverage"))


def normalise(expr: DataFrame, offset: float | None = 0.1) -> DataFrame:
    """Values scaled to a million an observation.

    offset: added to the coverage; None divides by the coverage itself, or by 1 where it is 0.
    """
    total = F.sum("value").over(Window.partitionBy("obs"))
    divisor = total + offset if offset is not None else F.when(total == 0, 1.0).otherwise(total)
    return expr.withColumn("value", F.lit(1e6) * F.col("value") / divisor)


def log_pseudocount(expr: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    """log10(value + pseudocount) of the values there are; what isn't there has log10(pseudocount), not 0.

    For all values take ``log_vectors`` of dense rows, as the pipelines do.
    """
    return expr.withColumn("value", F.log10(F.col("value") + pseudocount))


def log_vectors(rows: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    """Vectors ``v`` with log10(x + pseudocount) at every place, zeros too."""
    return rows.withColumn("v", F.transform("v", lambda x: F.log10(x + pseudocount)))


def log1p10(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value") / F.log(F.lit(10.0)))


def dense(expr: DataFrame, obs: DataFrame, features: list[str]) -> DataFrame:
    """(obs columns, v): one array a row of ``obs`` in the order of ``features``, zeros filled in.

    The features are those selected (some hundreds), so their places can be broadcast.
    """
    places = expr.sparkSession.createDataFrame(list(enumerate(features)), "pos int, feature string")
    held = expr.join(F.broadcast(places), "feature").groupBy("obs").agg(F.collect_list("pos").alias("_pos"), F.collect_list(F.col("value").cast("double")).alias("_val"))
    names, width = obs.columns, len(features)
    joined = obs.join(held, "obs", "left").select(*names, "_pos", "_val")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, val = batch.column("_pos"), batch.column("_val")
            out = np.zeros((batch.num_rows, width))
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(pos), 0).to_numpy())
            out[owner, pos.flatten().to_numpy()] = val.flatten().to_numpy()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield pa.record_batch([*[batch.column(c) for c in names], vectors], [*names, "v"])

    return joined.mapInArrow(rows, StructType([*obs.schema.fields, StructField("v", ArrayType(DoubleType()))]))


def moments(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(pos, mean, sd) of each place of the vectors ``v``: population moments, by weight if one is named."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = rows.select(w.alias("w"), F.posexplode("v").alias("pos", "x"))
    sums = long.groupBy("pos").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("pos", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def standardise(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Vectors with (x - mean) / sd; 0 where sd is 0."""
    held = stats.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "sd"))).alias("stats"))  # one entry a place
    value = F.zip_with("v", "stats", lambda x, s: F.when(s["sd"] < 1e-12, 0.0).otherwise((x - s["mean"]) / s["sd"]))
    return rows.crossJoin(F.broadcast(held)).withColumn("v", value).drop("stats")


def replicate(rows: DataFrame, size: str = "n_cells") -> DataFrame:
    """Each row as often as its size says, numbered from 1 in ``replica`` and named {label}_{replica}."""
    many = rows.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))))
    return many.withColumn("name", F.concat_ws("_", "label", F.col("replica").cast("string")))
