"""Every query with SQL gives what DuckDB gives; the others run."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from tessera.operators import embed
from tessera.plans import queries as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _sorted(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    result = db.execute(SQL[name])
    names = [c[0] for c in result.description]
    order = [names.index(c) for c in got.columns]
    assert _sorted(got.collect()) == _sorted([tuple(r[i] for i in order) for r in result.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"closest_average", "embed_tsne"}))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_tsne_embeds_every_new_observation(spark, db, sf_dir):
    new = db.execute("SELECT count(*) FROM customer WHERE c_custkey % 5 = 0").fetchone()[0]
    atlas = db.execute("SELECT sum(least(n, 20)) FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_mktsegment)").fetchone()[0]
    rows = QUERIES["embed_tsne"](spark, sf_dir).collect()
    assert {d: sum(r["dataset"] == d for r in rows) for d in ("New", "Atlas")} == {"New": new, "Atlas": atlas}
    assert all(math.isfinite(r["dim_1"]) and math.isfinite(r["dim_2"]) and r["label"] for r in rows)


def test_closest_average_runs(spark, sf_dir):
    labels = {r["label"] for r in QUERIES["label_counts"](spark, sf_dir).collect()}
    assert {r["label"] for r in QUERIES["closest_average"](spark, sf_dir).collect()} <= labels


def test_tsne_layout(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(20.0 * (i % 2), 1, 5).tolist(), str(i % 2), "New") for i in range(40)]
    table = spark.createDataFrame(rows, "v array<double>, label string, dataset string")
    got = embed.layout(table, "tsne", perplexity=8).toPandas()
    a, b = (got.loc[got["label"] == x, ["dim_1", "dim_2"]].to_numpy() for x in "01")
    assert len(a) == len(b) == 20
    far = np.linalg.norm(a[:, None] - b[None, :], axis=2).min()
    assert far > max(np.linalg.norm(x[:, None] - x[None, :], axis=2).mean() for x in (a, b))
    monkeypatch.setattr(embed, "MOST_ROWS", 39)
    with pytest.raises(ValueError):
        embed.layout(table, "tsne")


def test_replicas_are_as_many_as_labelled_observations(spark, db, sf_dir):
    sizes = dict(db.execute("SELECT c_mktsegment, count(*) FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1").fetchall())
    assert max(sizes.values()) > 7
    rows = QUERIES["replicate_by_size"](spark, sf_dir).collect()
    assert {(r["label"], r["replica"]) for r in rows} == {(label, i + 1) for label, n in sizes.items() for i in range(n)} and len(rows) == sum(sizes.values())
