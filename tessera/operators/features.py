"""Feature selection: markers of labels and of pairs of labels, and overdispersed features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_fold(a: Column, b: Column) -> Column:
    return F.log2(a + 0.1) - F.log2(b + 0.1)


def feature_overlap(atlas: DataFrame, new: DataFrame) -> DataFrame:
    return atlas.select("feature").intersect(new.select("feature"))


def profiles(expr: DataFrame, obs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(label, feature, total, n_cells) for every label and feature of ``expr``, zeros filled in."""
    counts = obs.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"))
    used = expr if features is None else expr.join(features, "feature", "left_semi")
    sums = used.join(obs.select("obs", "label").where("label is not null"), "obs").groupBy("label", "feature").agg(F.sum("value").alias("total"))
    grid = sums.select("feature").distinct().crossJoin(F.broadcast(counts))  # labels are few
    return grid.join(sums, ["label", "feature"], "left").select("label", "feature", F.coalesce("total", F.lit(0.0)).alias("total"), "n_cells")


def markers(profile: DataFrame, n: int, rest: str = "unweighted") -> DataFrame:
    """(label, feature, fold, rank): the n features of each label with the largest fold over the rest.

    rest: "unweighted" is the mean of the other labels' means, "weighted" the mean over their observations.
    """
    if n <= 0:
        return profile.select("label", "feature", F.lit(0.0).alias("fold"), F.lit(0).alias("rank")).limit(0)
    by_feature = Window.partitionBy("feature")
    mean = F.col("total") / F.col("n_cells")
    if rest == "unweighted":
        others = (F.sum(mean).over(by_feature) - mean) / (F.count(F.lit(1)).over(by_feature) - 1)
    else:
        others = (F.sum("total").over(by_feature) - F.col("total")) / (F.sum("n_cells").over(by_feature) - F.col("n_cells"))
    several = F.count(F.lit(1)).over(by_feature) > 1
    scored = profile.select("label", "feature", F.when(several, F.round(log_fold(mean, others), 9)).alias("fold")).where("fold is not null")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("fold"), "feature"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def similar_pairs(profile: DataFrame, fraction: float) -> DataFrame:
    """(a, b, dist): the int(labels * fraction) pairs of labels with the closest mean profiles."""
    mean = profile.select("label", "feature", (F.col("total") / F.col("n_cells")).alias("mean"))
    a, b = (mean.select(F.col("label").alias(x), "feature", F.col("mean").alias(f"mean_{x}")) for x in "ab")
    pairs = a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.round(F.sqrt(F.sum((F.col("mean_a") - F.col("mean_b")) ** 2)), 9).alias("dist"))
    n = int(profile.select("label").distinct().count() * fraction)
    return pairs.orderBy("dist", "a", "b").limit(n)


def pairwise_markers(profile: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, feature, fold, rank): the n features that tell the labels of each pair apart."""
    mean = profile.select("label", "feature", (F.col("total") / F.col("n_cells")).alias("mean"))
    few = F.broadcast(pairs.select("a", "b"))
    a = mean.join(few, F.col("label") == F.col("a")).select("a", "b", "feature", F.col("mean").alias("x"))
    both = a.join(mean.select(F.col("label").alias("b"), "feature", F.col("mean").alias("y")), ["b", "feature"])
    scored = both.select("a", "b", "feature", F.round(F.abs(log_fold(F.col("x"), F.col("y"))), 9).alias("fold"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("fold"), "feature"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def feature_moments(expr: DataFrame, n_obs: int | Column) -> DataFrame:
    """(feature, mean, var): population moments over n_obs observations, zeros counted."""
    n = n_obs if isinstance(n_obs, Column) else F.lit(float(n_obs))
    sums = expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n
    return sums.select("feature", mean.alias("mean"), (F.col("q") / n - mean * mean).alias("var"))


def overdispersed(moments: DataFrame, n: int) -> DataFrame:
    """(feature, fano): the n features with the largest Fano factor."""
    fano = F.round((F.col("var") + 1e-10) / (F.col("mean") + 1e-10), 9)
    return moments.select("feature", fano.alias("fano")).orderBy(F.desc("fano"), "feature").limit(n)


def select_features(overlap: DataFrame, *chosen: DataFrame, additional: list[str] | None = None) -> DataFrame:
    """(feature): the union of what was chosen and of the additional features, within the overlap."""
    parts = [c.select("feature") for c in chosen]
    if additional:
        parts.append(overlap.where(F.col("feature").isin(list(additional))).select("feature"))
    if not parts:
        raise ValueError("no features selected")
    return reduce(DataFrame.unionAll, parts).distinct().join(overlap, "feature", "left_semi")
