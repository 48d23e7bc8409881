"""What has to hold at any size: no more leaves a task than is kept, and nothing is refused for its size."""

from functools import partial

import numpy as np
import pytest

from tessera.operators import community as K
from tessera.operators import embed
from tessera.operators import knn as N
from tessera.operators import screen
from tessera.plans import queries as plans


def _brute(q_ids, q, c_ids, c, k, metric, limit=np.inf):
    found = np.round(N.distances(q, c, metric), 9)
    found[(q_ids[:, None] == c_ids[None, :]) | ~(found <= limit)] = np.inf
    order = np.argsort(c_ids)
    found, c_ids = found[:, order], c_ids[order]
    best = np.argsort(found, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(found, best, axis=1)
    row, col = np.nonzero(np.isfinite(d))
    return list(zip(q_ids[row].tolist(), c_ids[best[row, col]].tolist(), d[row, col].tolist()))


def _odd(kind, rng, n, width):
    x = rng.normal(size=(n, width))
    if kind == "copies":
        x[20 : n // 2] = x[0]
    elif kind == "steps":
        x = np.round(x)
    elif kind == "far":
        x = x * 1e3 + 1e7
    elif kind == "holes":
        x[3, 0], x[5, 0], x[7], x[8], x[9] = np.nan, np.inf, 0, 0, 1e9
    return x


@pytest.mark.parametrize("metric", N.METRICS)
def test_screened_neighbours_are_those_of_all_pairs(metric):
    rng = np.random.default_rng(1)
    for kind in ("plain", "copies", "steps", "far", "holes"):
        for width in (32, 3):
            x, ids = _odd(kind, rng, 400, width), rng.permutation(1000)[:400]
            for k, limit in ((5, np.inf), (30, 0.6)):
                best = screen.Best(ids[:150], x[:150], k, metric, limit)
                for i in range(0, 400, 90):
                    best.meet(ids[i : i + 90], x[i : i + 90])
                assert best.dist.shape == (len(best.ids), k)  # so much leaves a task, whatever the number of blocks
                assert list(zip(*(y.tolist() for y in best.found()))) == _brute(ids[:150], x[:150], ids, x, k, metric, limit)


@pytest.mark.parametrize("metric", N.METRICS)
def test_neighbours_over_many_blocks_and_partitions(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PART_BYTES", 40 * 8 * 6)  # of 120 rows a partition has some 40
    x, ids = _odd("copies", np.random.default_rng(2), 120, 6), np.arange(120) * 7 % 240
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    got = [(r["src"], r["dst"], r["dist"]) for r in N.nearest(rows, rows, 4, metric).orderBy("src", "rank").collect()]
    assert got == sorted(_brute(ids, x, ids, x, 4, metric), key=lambda r: (r[0], r[2], r[1]))


def test_cliques_are_not_compared_with_each_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "ab"[i % 2] if i < 40 else None) for i in range(60)], "id long, v array<double>, label string")
    monkeypatch.setattr(N, "SHARE", 7)
    graph = N.graph_average(rows, 5, 3, "correlation", 2.0)
    assert graph._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # what sorts out double edges is below, for the others
    got = [tuple(r) for r in graph.collect()]
    assert len(got) == len(set(got)) and {(a, b) for a in range(40) for b in range(a + 2, 40, 2)} <= set(got)


def test_grid_pushes_as_all_pairs_do():
    y = np.random.default_rng(5).normal(size=(800, 2)) * [1, 6]
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    push, total = embed._repulsion(y)
    want = (q * q)[:, :, None] * d
    assert abs(total / (q.sum() - 800) - 1) < 1e-3
    assert np.abs(push - want.sum(axis=1)).max() < 0.01 * np.abs(want.sum(axis=1)).max()


def test_large_tsne_keeps_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(embed, "PAIRS", 1 << 11)  # several blocks
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(3 * i, rng.normal(20.0 * (i % 2), 1, 5).tolist()) for i in range(120)], "id long, v array<double>")
    got = {r["id"]: (r["dim_1"], r["dim_2"]) for r in embed.spread(rows, perplexity=8, steps=60).collect()}
    assert sorted(got) == [3 * i for i in range(120)]
    a, b = (np.array([got[3 * i] for i in range(120) if i % 2 == x]) for x in (0, 1))
    assert np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) > 2 * max(x.std() for x in (a, b))


def test_tsne_query_beyond_one_task(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(embed, "MOST_ROWS", 100)  # sf0.001 has more rows; the query used to fail
    monkeypatch.setattr(embed, "spread", partial(embed.spread, steps=2))
    rows = plans.queries()["embed_tsne"](spark, sf_dir).collect()
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 5 = 0").count()
    assert sum(r["dataset"] == "New" for r in rows) == new and len(rows) > 100
    assert all(np.isfinite([r["dim_1"], r["dim_2"]]).all() and r["label"] for r in rows)


def test_a_move_works_out_a_communitys_term_once(monkeypatch):
    rng = np.random.default_rng(6)
    pairs = np.unique(np.sort(rng.integers(0, 200, (900, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    ids, labels = np.arange(200), np.array([None] * 200, object)
    counted, tried, term, gain = [], [], K._State.term, K._State.gain
    monkeypatch.setattr(K._State, "term", lambda self, *x: counted.append(1) or term(self, *x))
    monkeypatch.setattr(K._State, "gain", lambda self, *x: tried.append(1) or gain(self, *x))
    K.detect(ids, labels, pairs[:, 0], pairs[:, 1], "cpm", 0.05, 0)
    assert counted and not tried  # four terms a community that is tried before


def test_clusters_are_numbered_without_one_task_for_all(spark):
    centres = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [5.0, 5.0])], "label string, v array<double>")
    clusters = spark.createDataFrame([(str(i), [float(i % 2) * 5 + d, float(i % 2) * 5]) for i in range(40) for d in (0.1, -0.1)], "cluster string, v array<double>")
    found = K.closest_labels(centres, clusters)
    assert {r["cluster"]: r["label"] for r in found.collect()} == {str(i): "ab"[i % 2] for i in range(40)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cluster#" not in "".join(x for x in plan.splitlines() if "row_number()" in x and "src#" not in x)
