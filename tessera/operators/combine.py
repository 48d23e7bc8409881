"""Landmark building and combination: averages, stratified samples, feature joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOINS = ("keep_first", "union", "intersection")


def label_counts(obs: DataFrame) -> DataFrame:
    """(label, n_cells), observations a label; those without a label don't count."""
    return obs.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"))


def average_landmark(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(label, feature, mean, n_cells): mean profile of each label, zeros counted."""
    sums = expr.join(obs.select("obs", "label").where("label is not null"), "obs").groupBy("label", "feature").agg(F.sum("value").alias("total"))
    return sums.join(F.broadcast(label_counts(obs)), "label").select("label", "feature", (F.col("total") / F.col("n_cells")).alias("mean"), "n_cells")


def stratified_sample(obs: DataFrame, n: int | dict[str, int] = 20, seed: int = 0) -> DataFrame:
    """At most ``n`` observations of each label, drawn by a seeded hash; a label missing from a dict is left out."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("obs", F.lit(seed)), "obs"))
    if isinstance(n, dict):
        limits = F.create_map(*[F.lit(x) for pair in n.items() for x in pair]) if n else None
        limit = F.coalesce(limits[F.col("label")], F.lit(0)) if n else F.lit(0)
    else:
        limit = F.lit(n)
    return obs.where("label is not null").withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def common_features(tables: list[DataFrame], join: str) -> DataFrame:
    """(feature) that a combination keeps."""
    if join not in JOINS:
        raise ValueError(f"join must be one of {JOINS}")
    names = [t.select("feature").distinct() for t in tables]
    if join == "keep_first":
        return names[0]
    every = reduce(DataFrame.unionAll, names)
    if join == "union":
        return every.distinct()
    return every.groupBy("feature").count().where(F.col("count") == len(tables)).select("feature")


def combine(tables: list[tuple[str, DataFrame]], join: str = "keep_first", kind: str = "average") -> DataFrame:
    """Landmark tables one on top of the other, cut to the features of ``join``.

    Observations are named {atlas}_{name}.  Averages carry their labels as names, so labels of different
    atlases stay apart; labelled samples keep their labels, so equal labels meet.
    """
    if not tables:
        raise ValueError("nothing to combine")
    keep = common_features([t for _, t in tables], join)
    parts = []
    for name, table in tables:
        if "obs" not in table.columns:  # averages, as ``average_landmark`` gives them
            table = table.withColumn("obs", F.col("label"))
        named = table.withColumn("dataset", F.lit(name)).withColumn("obs", F.concat_ws("_", F.lit(name), F.col("obs").cast("string")))
        parts.append(named.withColumn("label", F.concat_ws("_", F.lit(name), "label")) if kind == "average" else named)
    return reduce(DataFrame.unionByName, parts).join(keep, "feature", "left_semi")
