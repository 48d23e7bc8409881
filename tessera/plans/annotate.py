"""The two annotation pipelines, from landmark and new counts to an annotation for each new observation.

Inputs in long form: ``expr(obs, feature, value)`` with integer obs and without zeros, and ``obs(obs, label)``.
Configuration is immutable; values that have to give way to the data are worked out anew for each fit.
"""

from __future__ import annotations

import logging
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import combine, community, features, knn, merge
from tessera.storage import written


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    n_features_per_label: int = 30
    n_features_overdispersed: int = 500
    features_additional: tuple[str, ...] = ()
    n_pcs: int = 20
    n_neighbors: int = 10
    distance_metric: str = "correlation"
    threshold_neighborhood: float = 0.8
    clustering_metric: str = "cpm"
    resolution: float = 0.001
    normalize_counts: bool = True
    seed: int = 0

    def check(self) -> None:
        for name in ("n_features_per_label", "n_features_overdispersed"):
            value = getattr(self, name)
            if not isinstance(value, int) or value < 0:
                raise ValueError(f"{name} must be an integer of at least 0")
        if not (self.n_features_per_label or self.n_features_overdispersed or self.features_additional):
            raise ValueError("no features selected")
        if self.clustering_metric not in community.METRICS:
            raise ValueError(f"clustering_metric must be one of {community.METRICS}")
        if self.distance_metric not in knn.METRICS:
            raise NotImplementedError(f"distance_metric must be one of {knn.METRICS}")


@dataclass(frozen=True)
class AverageConfig(Config):
    """From one mean profile a label, with the number of its observations as weight."""

    n_cells_per_type: int | None = None
    n_neighbors_out_of_atlas: int = 5


@dataclass(frozen=True)
class SubsampleConfig(Config):
    """From single labelled observations."""

    n_neighbors_external: int = 0
    external_neighbors_mutual: bool = False
    threshold_neighborhood_external: float = 0.8
    fraction_similar_types: float = 0.1
    n_features_similar_types: int = 0
    resolution: float = 0.003


@dataclass
class Result:
    """What a fit leaves: each step as a DataFrame, and the annotation (obs, annotation, novel)."""

    overlap: DataFrame
    features: list[str]
    matrix: DataFrame
    scores: DataFrame
    loadings: np.ndarray
    graph: DataFrame
    parts: DataFrame
    annotation: DataFrame
    config: Config
    average: bool
    new_ids: DataFrame = field(repr=False, default=None)

    def closest(self) -> DataFrame:
        """(cluster, label, dist): the known label nearest to each novel cluster."""
        rows, metric = (self.scores, "euclidean") if self.average else (self.matrix, self.config.distance_metric)
        named = rows.join(self.new_ids, ["side", "obs"]).where("side = 'new'").join(self.annotation.where("novel"), "obs")
        centres = rows.where("label is not null").select(F.col("label").alias("cluster"), "v")
        mean = centres.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
        mean = mean.groupBy(F.col("cluster").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
        return community.closest_labels(mean, named.select(F.col("annotation").alias("cluster"), "v"), metric)

    def embed(self, method: str = "pca", n: int = 2, perplexity: float = 30.0, seed: int = 0) -> DataFrame:
        """(dim_1, ..., label, dataset): coordinates of atlas and new rows."""
        table = self.scores.join(self.annotation.select(F.lit("new").alias("side"), "obs", "annotation"), ["side", "obs"], "left")
        table = table.select("id", "v", F.coalesce("label", "annotation").alias("label"), F.when(F.col("side") == "new", "New").otherwise("Atlas").alias("dataset"))
        if method == "pca":
            return table.select(*[F.col("v")[i].alias(f"dim_{i + 1}") for i in range(n)], "label", "dataset")
        if method not in ("tsne", "umap"):
            raise ValueError("method must be pca, tsne or umap")
        from tessera.operators import embed

        if method == "tsne" and n == 2 and self.scores.count() > embed.MOST_ROWS:
            return embed.spread(self.scores, perplexity).join(table.select("id", "label", "dataset"), "id").drop("id")
        return embed.layout(table.drop("id"), method, n, perplexity, seed)

    def merged(self) -> DataFrame:
        """The merged rows with their source and, for new ones, their annotation as label."""
        new = self.annotation.select(F.lit("new").alias("side"), "obs", "annotation")
        return self.matrix.join(new, ["side", "obs"], "left").select("side", "obs", F.coalesce("label", "annotation").alias("label"), "v")


def _require(table: DataFrame, what: str, *columns: str) -> None:
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise ValueError(f"{what} needs the columns {missing}")


def _overlap(atlas: DataFrame, new: DataFrame) -> DataFrame:
    overlap = written(features.feature_overlap(atlas, new), "overlap")
    n = overlap.count()
    if not n:
        raise ValueError("atlas and new data share no features")
    if n < 50:
        warnings.warn(f"only {n} features are shared", stacklevel=3)
    return overlap


def _given(name: str, asked: int, used: int) -> int:
    """The value that the data allow, with a word to the user if it isn't the one asked for."""
    if used != asked:
        warnings.warn(f"{name} is {asked}, but the data allow {used} only", stacklevel=4)
        log.warning("%s reduced from %d to %d", name, asked, used)
    return used


def _finish(rows: DataFrame, wide: DataFrame, names: list[str], overlap: DataFrame, config: Config, average: bool, weight: str | None) -> Result:
    """rows: (side, obs, label, v, n_cells) standardised; wide: the normalised ones."""
    n_rows, n_new = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("side") == "new", 1))).first()
    log.info("%d rows, %d of them new, and %d features", n_rows, n_new, len(names))
    n_pcs = _given("n_pcs", config.n_pcs, min(config.n_pcs, n_rows, len(names)))
    k = _given("n_neighbors", config.n_neighbors, config.n_neighbors if n_new >= config.n_neighbors + 1 else max(1, n_new - 1))
    scores, loadings, _ = knn.principal_components(rows, n_pcs, weight)
    if average:
        scores = scores.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("n_cells").cast("int"))))
    else:
        scores = scores.withColumn("replica", F.lit(1))
    # Even numbers for the atlas, its replicas side by side, and odd ones for new rows; no order over all rows is needed.
    most = rows.agg(F.max("n_cells")).first()[0] + 1 if average else 1
    own = F.when(F.col("side") == "new", 2 * F.col("obs") + 1).otherwise(2 * (F.col("obs") * most + F.col("replica")))
    scores = written(scores.withColumn("id", own.cast("long")), "scores")
    points = scores.select("id", "v", "label")
    if average:
        graph = knn.graph_average(points, k, config.n_neighbors_out_of_atlas, config.distance_metric, config.threshold_neighborhood)
    else:
        graph = knn.graph_subsample(points, k, config.distance_metric, config.threshold_neighborhood, config.n_neighbors_external, config.threshold_neighborhood_external, config.external_neighbors_mutual)
    graph = written(graph, "graph")
    vertices = points.select("id", "label")
    parts = community.pinned_communities(graph, vertices, config.clustering_metric, config.resolution, config.seed)
    parts = written(parts, "parts")
    named = community.annotations(parts, vertices).join(scores.where("side = 'new'").select("id", "obs"), "id").select("obs", "annotation", "novel")
    return Result(overlap, names, wide, scores, loadings, graph, parts, named, config, average, scores.where("side = 'new'").select("side", "obs"))


def annotate_average(average: DataFrame, new_expr: DataFrame, new_obs: DataFrame, config: AverageConfig | None = None) -> Result:
    """average: (label, feature, mean, n_cells), one profile a label."""
    config = config or AverageConfig()
    config.check()
    _require(average, "average", "label", "feature", "mean", "n_cells")
    _require(new_expr, "new_expr", "obs", "feature", "value")
    _require(new_obs, "new_obs", "obs")
    # Both are read several times and may be long joins themselves.
    average, new_expr = written(average, "average"), written(new_expr.select("obs", "feature", "value"), "new")
    overlap = _overlap(average, new_expr)
    held = average.join(overlap, "feature", "left_semi")
    if config.n_cells_per_type is not None:
        average = average.withColumn("n_cells", F.lit(config.n_cells_per_type))
    sizes = average.groupBy("label").agg(F.max("n_cells").alias("n_cells"))
    grid = held.select("feature").distinct().crossJoin(F.broadcast(sizes.select("label")))
    profile = grid.join(held.select("label", "feature", F.col("mean").alias("total")), ["label", "feature"], "left").select("label", "feature", F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(1).alias("n_cells"))
    new = new_expr.join(overlap, "feature", "left_semi")
    chosen = [features.markers(profile, config.n_features_per_label, "unweighted")]
    if config.n_features_overdispersed:
        chosen.append(features.overdispersed(features.feature_moments(new, new_obs.count()), config.n_features_overdispersed))
    names = sorted(r[0] for r in features.select_features(overlap, *chosen, additional=list(config.features_additional)).collect())  # labels * markers + overdispersed at most
    if not names:
        raise ValueError("no features selected")
    chosen_names = overlap.sparkSession.createDataFrame([(x,) for x in names], "feature string")
    known = sorted((r["label"], r["n_cells"]) for r in sizes.collect())  # a row a label
    labels = overlap.sparkSession.createDataFrame([(x, n, i) for i, (x, n) in enumerate(known)], "label string, n_cells long, obs long")
    atlas = held.join(F.broadcast(labels), "label").select("obs", "feature", F.col("mean").alias("value"))

    def vectors(expr: DataFrame, obs: DataFrame) -> DataFrame:
        used = expr.join(F.broadcast(chosen_names), "feature", "left_semi")
        return merge.dense(merge.normalise(used, 0.1) if config.normalize_counts else used, obs, names)

    rows = vectors(atlas, labels.select("obs", "label", "n_cells")).select(F.lit("atlas").alias("side"), "obs", "label", F.col("n_cells").cast("long").alias("n_cells"), "v")
    rows = rows.unionByName(vectors(new_expr, new_obs.select("obs")).select(F.lit("new").alias("side"), "obs", F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("n_cells"), "v"))
    rows = written(rows, "rows")
    logged = merge.log_vectors(rows)
    ready = written(merge.standardise(logged, merge.moments(logged, "n_cells")), "standardised")
    return _finish(ready, rows, names, overlap, config, True, "n_cells")


def annotate_subsample(atlas_expr: DataFrame, atlas_obs: DataFrame, new_expr: DataFrame, new_obs: DataFrame, config: SubsampleConfig | None = None) -> Result:
    config = config or SubsampleConfig()
    config.check()
    _require(atlas_expr, "atlas_expr", "obs", "feature", "value")
    _require(atlas_obs, "atlas_obs", "obs", "label")
    _require(new_expr, "new_expr", "obs", "feature", "value")
    _require(new_obs, "new_obs", "obs")
    atlas_expr, new_expr = written(atlas_expr.select("obs", "feature", "value"), "atlas"), written(new_expr.select("obs", "feature", "value"), "new")
    overlap = _overlap(atlas_expr, new_expr)
    profile = features.profiles(atlas_expr, atlas_obs)
    shared = profile.join(overlap, "feature", "left_semi")
    chosen = [features.markers(shared, config.n_features_per_label, "weighted")]
    if config.n_features_similar_types:
        chosen.append(features.pairwise_markers(shared, features.similar_pairs(profile, config.fraction_similar_types), config.n_features_similar_types))
    if config.n_features_overdispersed:
        new = new_expr.join(overlap, "feature", "left_semi")
        chosen.append(features.overdispersed(features.feature_moments(new, new_obs.count()), config.n_features_overdispersed))
    names = sorted(r[0] for r in features.select_features(overlap, *chosen, additional=list(config.features_additional)).collect())
    if not names:
        raise ValueError("no features selected")
    chosen_names = overlap.sparkSession.createDataFrame([(x,) for x in names], "feature string")

    def vectors(expr: DataFrame, obs: DataFrame) -> DataFrame:
        used = expr.join(F.broadcast(chosen_names), "feature", "left_semi")
        return merge.dense(merge.normalise(used, None) if config.normalize_counts else used, obs, names)

    rows = vectors(atlas_expr, atlas_obs.where("label is not null").select("obs", "label")).select(F.lit("atlas").alias("side"), "obs", "label", "v")
    rows = rows.unionByName(vectors(new_expr, new_obs.select("obs")).select(F.lit("new").alias("side"), "obs", F.lit(None).cast("string").alias("label"), "v"))
    rows = written(rows.withColumn("n_cells", F.lit(1).cast("long")), "rows")
    logged = rows.withColumn("v", F.transform("v", lambda x: F.log1p(x) / F.log(F.lit(10.0))))
    ready = written(merge.standardise(logged, merge.moments(logged)), "standardised")
    return _finish(ready, rows, names, overlap, config, False, None)


def stratified_landmark(expr: DataFrame, obs: DataFrame, n: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A labelled sample of n observations a label: (expr, obs)."""
    chosen = combine.stratified_sample(obs, n, seed)
    return expr.join(chosen.select("obs"), "obs", "left_semi"), chosen
