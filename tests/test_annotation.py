"""Planted data, invariants and the ways that inputs can be wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import combine as C
from tessera.operators import community as K
from tessera.operators import features as S
from tessera.operators import knn as N
from tessera.operators import merge as M
from tessera.plans import annotate as A
from tessera.sources import atlas as L


@pytest.fixture(scope="module")
def planted(spark):
    """8 labels of 20 rows with 10 high features each; 80 new rows of known labels and 20 of a ninth kind."""
    rng = np.random.default_rng(3)

    def counts(kinds):
        mean = np.full((len(kinds), 120), 5.0)
        for i, k in enumerate(kinds):
            mean[i, k * 10 : k * 10 + 10] = 100
        return rng.poisson(mean)

    def long(x):
        rows = [(i, f"f{j:03d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
        return spark.createDataFrame(rows, "obs long, feature string, value double")

    kinds = np.repeat(np.arange(8), 20)
    new_kinds = np.concatenate((np.repeat(np.arange(8), 10), np.full(20, 8)))
    obs = spark.createDataFrame([(i, f"L{k}") for i, k in enumerate(kinds.tolist())], "obs long, label string")
    new_obs = spark.createDataFrame([(i,) for i in range(100)], "obs long")
    return long(counts(kinds)).cache(), obs, long(counts(new_kinds)).cache(), new_obs, new_kinds


def _agreement(result, kinds):
    rows = {r["obs"]: r for r in result.annotation.collect()}
    assert len(rows) == 100
    known = np.mean([rows[i]["annotation"] == f"L{kinds[i]}" for i in range(80)])
    return known, {rows[i]["annotation"] for i in range(80, 100)}, [rows[i]["novel"] for i in range(80, 100)]


def test_subsample_pipeline(planted):
    expr, obs, new, new_obs, kinds = planted
    result = A.annotate_subsample(expr, obs, new, new_obs, A.SubsampleConfig(n_pcs=9, n_features_per_label=10, n_features_overdispersed=40, resolution=0.05))
    known, novel, flags = _agreement(result, kinds)
    assert known >= 0.9 and len(novel) == 1 and all(flags)
    assert result.closest().count() == 1
    assert len(result.embed("pca").columns) == 4
    assert result.merged().where("label is null").count() == 0
    assert np.allclose(result.loadings.T @ result.loadings, np.eye(9), atol=1e-8)


def test_average_pipeline(planted):
    expr, obs, new, new_obs, kinds = planted
    result = A.annotate_average(C.average_landmark(expr, obs), new, new_obs, A.AverageConfig(n_pcs=8, n_features_per_label=10, n_features_overdispersed=40, n_cells_per_type=20, resolution=0.05))
    known, novel, flags = _agreement(result, kinds)
    assert known >= 0.9 and len(novel) == 1 and all(flags)
    assert result.scores.where("side = 'atlas'").count() == 160


def test_landmarks(planted):
    expr, obs, _, _, _ = planted
    assert C.stratified_sample(obs, 5).count() == 40
    assert C.stratified_sample(obs, {"L1": 3, "L2": 0}).count() == 3
    assert C.average_landmark(expr, obs).select("label").distinct().count() == 8


def test_weighted_covariance_is_that_of_replicas(spark):
    rows = spark.createDataFrame([(i, float(i % 3 + 1), [float(i), float(i * i % 7), float(i % 5)]) for i in range(12)], "id long, w double, v array<double>")
    _, a, x = N.principal_components(rows, 2, "w")
    many = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("id", "v")
    _, b, y = N.principal_components(many, 2)
    assert np.allclose(a, b) and np.allclose(x, y)


@pytest.mark.parametrize("metric", K.METRICS)
def test_pinned_labels_stay(spark, metric):
    clique = lambda k: [(k + i, k + j) for i in range(4) for j in range(i + 1, 4)]
    edges = spark.createDataFrame(clique(0) + clique(4) + [(3, 4)], "src long, dst long")
    vertices = spark.createDataFrame([(i, {0: "1", 4: "12"}.get(i)) for i in range(9)], "id long, label string")
    parts = K.pinned_communities(edges, vertices, metric, 0.1)
    comm = {r["id"]: r["comm"] for r in parts.collect()}
    assert comm[0] == 0 and comm[4] == 1 and comm[8] >= 2
    named = {r["id"]: r["annotation"] for r in K.annotations(parts, vertices).collect()}
    if metric in ("cpm", "modularity", "rbc", "rber"):
        assert [named[i] for i in (1, 2, 3, 5, 6, 7)] == ["1"] * 3 + ["12"] * 3


def test_zero_rows_and_constants(spark):
    zero = spark.createDataFrame([(0, "a", 0.0), (1, "a", 2.0)], "obs long, feature string, value double")
    assert {r["obs"]: r["value"] for r in M.normalise(zero, None).collect()} == {0: 0.0, 1: 1e6}
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 4.0])], "id long, v array<double>")
    assert sorted(r["v"] for r in M.standardise(rows, M.moments(rows)).collect()) == [[0.0, -1.0], [0.0, 1.0]]
    assert N.nearest(spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 3.0])], "id long, v array<double>"), rows, 1).where("src = 0").count() == 0


def test_sources(spark, tmp_path):
    wide = spark.createDataFrame([("INS", 2302, 123, 0), ("GCG", 0, 5034, 6453), ("PPY", 0, 0, 1)], "gene string, a int, b int, c int")
    assert sorted(map(tuple, L.from_wide(wide, "gene").collect())) == [(0, "INS", 2302.0), (1, "GCG", 5034.0), (1, "INS", 123.0), (2, "GCG", 6453.0), (2, "PPY", 1.0)]
    for name, features in (("x", "fg"), ("y", "gh")):
        spark.createDataFrame([("L", "L", f, 1.0) for f in features], "obs string, label string, feature string, mean double").write.parquet(f"{tmp_path}/{name}")
    (tmp_path / "catalogue.tsv").write_text(f"Atlas Name\tURL_average\tURL_subsample\nx\t{tmp_path}/x\t{tmp_path}/x\ny\t{tmp_path}/y\t{tmp_path}/y\n")
    catalogue = L.read_catalogue(spark, str(tmp_path / "catalogue.tsv"))
    assert [r[0] for r in L.list_atlases(catalogue).collect()] == ["x", "y"]
    kept = {j: {(r["label"], r["feature"]) for r in L.fetch_selected(catalogue, ["x", "y"], join=j).collect()} for j in C.JOINS}
    assert kept["keep_first"] == {("x_L", "f"), ("x_L", "g"), ("y_L", "g")}
    assert kept["union"] == kept["keep_first"] | {("y_L", "h")}
    assert kept["intersection"] == {("x_L", "g"), ("y_L", "g")}
    assert L.fetch_selected(catalogue, {"atlas_name": "x", "cell_types": ["M"]}).count() == 0
    for wrong in (lambda: L.fetch_atlas(catalogue, "x", "other"), lambda: L.fetch_selected(catalogue, []), lambda: C.combine([], "union"), lambda: L.fetch_selected(catalogue, ["x", "y"], join="other")):
        with pytest.raises(ValueError):
            wrong()


def test_arguments():
    for config in (A.AverageConfig(n_features_per_label=-1), A.AverageConfig(n_features_per_label=0, n_features_overdispersed=0), A.AverageConfig(clustering_metric="other")):
        with pytest.raises(ValueError):
            config.check()
    with pytest.raises(NotImplementedError):
        A.SubsampleConfig(distance_metric="jaccard").check()
    with pytest.raises(ValueError):
        S.select_features(None)


def _planted(n, groups, seed):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, groups, n)
    src = rng.integers(0, n, n * 8)
    dst = np.array([rng.choice(np.flatnonzero(own == own[s])) if rng.random() < 0.8 else rng.integers(0, n) for s in src])
    pairs = np.unique(np.sort(np.stack((src, dst), 1)[src != dst], axis=1), axis=0)
    return own, pairs[:, 0], pairs[:, 1]


@pytest.mark.parametrize("metric", K.METRICS)
def test_communities_are_pinned_connected_and_no_worse_than_planted(metric):
    own, src, dst = _planted(240, 6, 1)
    ids = np.arange(240) * 5 + 2
    labels = np.array([f"L{g}" if g < 3 and i % 4 == 0 else None for i, g in enumerate(own)], object)
    resolution = 0.05 if metric == "cpm" else 1.0
    comm = K.detect(ids, labels, ids[src], ids[dst], metric, resolution, 0)
    assert all(comm[i] == int(x[1]) for i, x in enumerate(labels) if x is not None)

    def quality(c):
        c = np.unique(c, return_inverse=True)[1]
        k = c.max() + 1
        e, n = np.bincount(c[src][c[src] == c[dst]], minlength=k).astype(float), np.bincount(c, minlength=k).astype(float)
        d = np.bincount(np.concatenate((c[src], c[dst])), minlength=k).astype(float)
        state = K._State(metric, resolution, len(src), len(c))
        return state.surprise(e.sum(), (n * (n - 1) / 2).sum()) if metric == "surprise" else sum(state.term(*x) for x in zip(e, n, d))

    assert quality(comm) >= quality(own) - 1e-9
    for c in set(comm.tolist()) - {0, 1, 2}:
        members = set(np.flatnonzero(comm == c).tolist())
        reached, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in reached:
                reached.add(v)
                todo += [u for a, b in zip(src, dst) for u in ((b,) if a == v else (a,) if b == v else ()) if u in members]
        assert reached == members


def test_communities_by_component(spark, monkeypatch):
    edges = [(a, b) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    vertices = [(i, "A" if i == 0 else "B" if i == 11 else None) for base in (0, 10, 20) for i in range(base, base + 5)] + [(99, None)]
    e, v = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(vertices, "id long, label string")
    want = {i: 0 if i < 10 else 1 if i < 20 else 2 if i < 99 else 3 for i, _ in vertices}
    for most in (10**6, 0):
        monkeypatch.setattr(K, "ONE_TASK", most)
        assert {r["id"]: r["comm"] for r in K.pinned_communities(e, v, "cpm", 0.1).collect()} == want


def test_matrix_graphs(spark):
    m = np.array([[0, 1, 0], [1, 2, 0], [0.5, 0, 0]])
    assert sorted(map(tuple, N.from_matrix(spark, m, [7, 3, 9]).collect())) == [(3, 7), (7, 9)]
    with pytest.raises(ValueError, match="shape"):
        N.from_matrix(spark, m[:2], [7, 3, 9])


def test_columns_are_checked_and_changes_are_told(spark):
    expr = spark.createDataFrame([(0, "f", 1.0)], "obs long, feature string, value double")
    with pytest.raises(ValueError, match="n_cells"):
        A.annotate_average(expr.withColumnRenamed("obs", "label"), expr, expr.select("obs"))
    with pytest.warns(UserWarning, match="n_pcs is 20"):
        assert A._given("n_pcs", 20, 3) == 3


def test_names_of_wide_columns(spark):
    wide = spark.createDataFrame([("f", 1.0, 0.0)], "feature string, `a.b` double, c double")
    assert [tuple(r) for r in L.wide_names(wide, "feature").orderBy("obs").collect()] == [(0, "a.b"), (1, "c")]
    assert [tuple(r) for r in L.from_wide(wide, "feature").collect()] == [(0, "f", 1.0)]
