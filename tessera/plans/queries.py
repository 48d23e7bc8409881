"""Queries of the annotation engine over the driver's tables, and their SQL.

Counts: what each customer ordered, by brand and type of part; labels: market segments; four customers in five
are the atlas, the rest is new.  A second atlas has suppliers by region, of small parts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import combine as C
from tessera.operators import community as K
from tessera.operators import features as S
from tessera.operators import knn as N
from tessera.operators import merge as M
from tessera.plans import annotate as A
from tessera.sources.atlas import filter_labels

Query = Callable[[SparkSession, str], DataFrame]
TOP, OVER = 10, 20
LABELS = ["BUILDING", "MACHINERY"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
        part = t("part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("feature"), "p_size")
        lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        sold = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        self.expr = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("o_custkey").alias("obs"), "feature").agg(F.sum("l_quantity").alias("value"))
        people = t("customer").select(F.col("c_custkey").alias("obs"), F.col("c_mktsegment").alias("label"))
        self.obs, self.new_obs = people.where("obs % 5 <> 0"), people.where("obs % 5 = 0")
        self.atlas, self.new = self.expr.where("obs % 5 <> 0"), self.expr.where("obs % 5 = 0")
        second = lines.join(part.where("p_size <= 25"), F.col("l_partkey") == F.col("p_partkey"))
        self.expr_b = second.groupBy(F.col("l_suppkey").alias("obs"), "feature").agg(F.sum("l_quantity").alias("value"))
        nation = t("nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("label"))
        self.obs_b = t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("obs"), "label")
        self.truth = t("embeddings").select(F.col("vec_id").alias("obs"), F.col("label").cast("string").alias("label"))
        self.vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.when(F.col("vec_id") % 4 == 0, F.col("label").cast("string")).alias("label"))


def _query(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


def _r(name: str):
    return F.round(name, 6).alias(name)


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _two_atlases(t: Tables) -> list[tuple[str, DataFrame]]:
    return [(name, C.average_landmark(e, o)) for name, e, o in (("cust", t.atlas, t.obs), ("supp", t.expr_b, t.obs_b))]


def _combined(join: str) -> Query:
    return _query(lambda t: C.combine(_two_atlases(t), join).select("label", "feature", _r("mean"), _long("n_cells"), "dataset"))


def _scaled(t: Tables) -> DataFrame:
    return M.normalise(t.new, 0.1)


def _knn(metric: str) -> Query:
    return _query(lambda t: N.nearest(t.vectors, t.vectors, 5, metric).select("src", "dst", _r("dist"), _long("rank")))


def _fixed_parts(t: Tables) -> DataFrame:
    return t.vectors.select("id", (F.col("id") % 7).alias("comm"))


def _ring(t: Tables) -> DataFrame:
    return N.undirected(t.vectors.select(F.col("id").alias("src"), (F.col("id") * F.col("id") % 101).alias("dst")))


def _ring_all(t: Tables) -> DataFrame:
    n = t.vectors.select("id")
    return _ring(t).join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _average_fit(t: Tables) -> A.Result:
    return A.annotate_average(C.average_landmark(t.atlas, t.obs), t.new, t.new_obs, A.AverageConfig(n_cells_per_type=20, n_pcs=10, n_features_overdispersed=60))


def _subsample_fit(t: Tables) -> A.Result:
    expr, obs = A.stratified_landmark(t.atlas, t.obs, 20)
    return A.annotate_subsample(expr, obs, t.new, t.new_obs, A.SubsampleConfig(n_pcs=10, n_features_overdispersed=60, n_neighbors_external=3, n_features_similar_types=5, fraction_similar_types=0.4))


def _dense_new(t: Tables) -> DataFrame:
    names = sorted(r[0] for r in S.overdispersed(S.feature_moments(t.new, t.new_obs.count()), 12).collect())
    return M.dense(M.log1p10(M.normalise(t.new, None)), t.new_obs.select("obs"), names)


def _pca(t: Tables) -> DataFrame:
    rows = _dense_new(t)
    scores, _, _ = N.principal_components(M.standardise(rows, M.moments(rows)), 4)
    return scores.select("obs", *[F.round(F.col("v")[i], 6).alias(f"pc_{i + 1}") for i in range(4)])


def _closest(t: Tables, metric: str = "euclidean") -> DataFrame:
    centres = t.vectors.where("id < 6").select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"), "v")
    clusters = t.vectors.where("id >= 6").select((F.col("id") % 9).cast("string").alias("cluster"), "v")
    return K.closest_labels(centres, clusters, metric).select("cluster", "label", _r("dist"))


def _covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov, _ = N.covariance(Tables(spark, sf_dir).vectors.withColumn("w", F.col("id") % 5 + 1), "w")
    rows = [(i, j, round(float(cov[i, j]), 6)) for i in range(len(cov)) for j in range(i, len(cov))]  # places by places
    return spark.createDataFrame(rows, "a long, b long, cov double")


def _pca_distances(weight: str | None) -> Query:
    """Squared distance of each row to the row of the next id in all components, which is that of the vectors themselves."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        rows = t.vectors.withColumn("w", F.col("id") % 5 + 1).select("id", "w", "v")
        scores, loadings, _ = N.principal_components(rows, len(rows.first()["v"]), weight)
        x = scores.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("v").alias("x"))
        y = scores.select(F.col("id").alias("dst"), F.col("v").alias("y"))
        d = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)
        return x.join(y, "dst").select("src", "dst", F.round(d, 5).alias("dist"))

    return run


def _agreement(t: Tables) -> DataFrame:
    found = N.external_neighbours(t.vectors, 1, "correlation", 0.9).join(t.vectors.select(F.col("id").alias("dst"), "label"), "dst")
    return K.agreement(found.select(F.col("src").alias("obs"), F.col("label").alias("annotation")), t.truth).select("n", "agree", _r("share"))


PAIRS = 0.4
QUERIES: dict[str, Query] = {
    "average_landmark": _query(lambda t: C.average_landmark(t.atlas, t.obs).select("label", "feature", _r("mean"), _long("n_cells"))),
    "label_counts": _query(lambda t: C.label_counts(t.obs).select("label", _long("n_cells"))),
    "stratified_sample": _query(lambda t: C.stratified_sample(t.obs, 20)),
    "stratified_sample_counts": _query(lambda t: C.stratified_sample(t.obs, 20).groupBy("label").agg(F.count(F.lit(1)).alias("n"))),
    "label_filter": _query(lambda t: filter_labels(t.obs, LABELS)),
    "combine_keep_first": _combined("keep_first"),
    "combine_union": _combined("union"),
    "combine_intersection": _combined("intersection"),
    "feature_overlap": _query(lambda t: S.feature_overlap(t.expr_b, t.new)),
    "markers_unweighted_rest": _query(lambda t: S.markers(S.profiles(t.atlas, t.obs), TOP, "unweighted").select("label", "feature", _r("fold"), _long("rank"))),
    "markers_cell_weighted_rest": _query(lambda t: S.markers(S.profiles(t.atlas, t.obs), TOP, "weighted").select("label", "feature", _r("fold"), _long("rank"))),
    "similar_label_pairs": _query(lambda t: S.similar_pairs(S.profiles(t.atlas, t.obs), PAIRS).select("a", "b", _r("dist"))),
    "pairwise_markers": _query(lambda t: S.pairwise_markers(p := S.profiles(t.atlas, t.obs), S.similar_pairs(p, PAIRS), TOP).select("a", "b", "feature", _r("fold"), _long("rank"))),
    "feature_mean_var": _query(lambda t: S.feature_moments(t.new, t.new_obs.count()).select("feature", _r("mean"), _r("var"))),
    "overdispersed_topn": _query(lambda t: S.overdispersed(S.feature_moments(t.new, t.new_obs.count()), OVER).select("feature", _r("fano"))),
    "selected_features": _query(lambda t: S.select_features(S.feature_overlap(t.atlas, t.new), S.markers(S.profiles(t.atlas, t.obs), TOP), S.overdispersed(S.feature_moments(t.new, t.new_obs.count()), OVER))),
    "coverage": _query(lambda t: M.coverage(t.new).select("obs", _r("coverage"))),
    "normalise_offset": _query(lambda t: _scaled(t).select("obs", "feature", _r("value"))),
    "normalise_guarded": _query(lambda t: M.normalise(t.new, None).select("obs", "feature", _r("value"))),
    "log_pseudocount": _query(lambda t: M.log_pseudocount(_scaled(t)).select("obs", "feature", _r("value"))),
    "log1p10": _query(lambda t: M.log1p10(M.normalise(t.new, None)).select("obs", "feature", _r("value"))),
    "weighted_moments": _query(lambda t: M.moments(t.vectors.withColumn("w", F.col("id") % 5 + 1), "w").select(_long("pos"), _r("mean"), _r("sd"))),
    "standardise": _query(lambda t: M.standardise(t.vectors, M.moments(t.vectors)).select("id", F.posexplode("v").alias("pos", "x")).select("id", _long("pos"), _r("x"))),
    "replicate_by_size": _query(lambda t: M.replicate(C.label_counts(t.obs)).select("label", _long("replica"), "name")),
    "pca_unweighted": _query(_pca),
    "pca_distances": _pca_distances(None),
    "pca_weighted_distances": _pca_distances("w"),
    "weighted_covariance": _covariance,
    "combine_prefixed_names": _query(lambda t: C.combine(_two_atlases(t), "union").select("obs", "dataset").distinct()),
    "replica_clique": _query(lambda t: N.replica_cliques(t.vectors)),
    "label_agreement": _query(_agreement),
    "closest_subsample": _query(lambda t: _closest(t, "correlation")),
    "knn_out_of_atlas": _query(lambda t: N.out_of_atlas(t.vectors, 3, "correlation", 0.9).select("label", "src", "dst", _r("dist"), _long("rank"))),
    "knn_external": _query(lambda t: N.external_neighbours(t.vectors, 5, "correlation", 0.9).select("src", "dst", _r("dist"), _long("rank"))),
    "knn_external_mutual": _query(lambda t: N.external_neighbours(t.vectors, 5, "correlation", 0.9, True).select("src", "dst", _r("dist"), _long("rank"))),
    "graph_average": _query(lambda t: N.graph_average(t.vectors, 5, 3, "correlation", 0.9)),
    "graph_subsample": _query(lambda t: N.graph_subsample(t.vectors, 5, "correlation", 0.9, 3, 0.9)),
    "external_graph_edges": _query(_ring),
    "initial_partition": _query(lambda t: K.initial_partition(t.vectors.select("id", "label"))),
    **{f"partition_quality_{m}": _query(lambda t, m=m: K.partition_quality(_ring_all(t), _fixed_parts(t), m, 0.01)) for m in K.METRICS},
    **{f"knn_{m}": _knn(m) for m in ("correlation", "cosine", "euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra", "braycurtis", "minkowski")},
    **{f"pinned_clusters_{m}": _query(lambda t, m=m: K.pinned_communities(_ring_all(t), t.vectors.select("id", "label"), m, 0.05)) for m in K.METRICS},
    "closest_label": _query(_closest),
    "annotate_average": _query(lambda t: _average_fit(t).annotation),
    "annotate_subsample": _query(lambda t: _subsample_fit(t).annotation),
    "closest_average": _query(lambda t: _average_fit(t).closest()),
    "embed_pca": _query(lambda t: _subsample_fit(t).embed("pca")),
    "embed_tsne": _query(lambda t: A.annotate_subsample(*A.stratified_landmark(t.atlas, t.obs, 20), t.new, t.new_obs, A.SubsampleConfig(n_pcs=5, n_features_overdispersed=30)).embed("tsne")),
}

PRE = """WITH expr AS (SELECT o_custkey AS obs, p_brand || '|' || p_type AS feature, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
people AS (SELECT c_custkey AS obs, c_mktsegment AS label FROM customer),
o AS (SELECT * FROM people WHERE obs % 5 <> 0), a AS (SELECT * FROM expr WHERE obs % 5 <> 0), nw AS (SELECT * FROM expr WHERE obs % 5 = 0),
nn AS (SELECT count(*) AS n FROM people WHERE obs % 5 = 0),
cnt AS (SELECT label, count(*) AS n_cells FROM o GROUP BY 1),
sums AS (SELECT label, feature, sum(value) AS total FROM a JOIN o USING (obs) GROUP BY 1, 2),
expr_b AS (SELECT l_suppkey AS obs, p_brand || '|' || p_type AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY 1, 2),
o_b AS (SELECT s_suppkey AS obs, n_regionkey::VARCHAR AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cnt_b AS (SELECT label, count(*) AS n_cells FROM o_b GROUP BY 1),
sums_b AS (SELECT label, feature, sum(value) AS total FROM expr_b JOIN o_b USING (obs) GROUP BY 1, 2),
both_atlases AS (SELECT 'cust_' || label AS label, feature, total / n_cells AS mean, n_cells, 'cust' AS dataset FROM sums JOIN cnt USING (label)
  UNION ALL SELECT 'supp_' || label, feature, total / n_cells, n_cells, 'supp' FROM sums_b JOIN cnt_b USING (label)),
prof AS (SELECT c.label, f.feature, coalesce(s.total, 0) AS total, c.n_cells FROM (SELECT DISTINCT feature FROM sums) f CROSS JOIN cnt c LEFT JOIN sums s ON s.label = c.label AND s.feature = f.feature),
mk AS (SELECT label, feature, round(log2(total / n_cells + 0.1) - log2((sum(total / n_cells) OVER w - total / n_cells) / (count(*) OVER w - 1) + 0.1), 9) AS fold,
  round(log2(total / n_cells + 0.1) - log2((sum(total) OVER w - total) / (sum(n_cells) OVER w - n_cells) + 0.1), 9) AS fold_w FROM prof WINDOW w AS (PARTITION BY feature)),
mu AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fold DESC, feature) AS rank FROM mk),
mw AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fold_w DESC, feature) AS rank FROM mk),
pr AS (SELECT x.label AS a, y.label AS b, round(sqrt(sum((x.total / x.n_cells - y.total / y.n_cells) ** 2)), 9) AS dist FROM prof x JOIN prof y ON x.feature = y.feature AND x.label < y.label GROUP BY 1, 2 ORDER BY dist, a, b LIMIT 2),
pm AS (SELECT a, b, x.feature, round(abs(log2(x.total / x.n_cells + 0.1) - log2(y.total / y.n_cells + 0.1)), 9) AS fold FROM pr JOIN prof x ON x.label = a JOIN prof y ON y.label = b AND y.feature = x.feature),
mom AS (SELECT feature, sum(value) / n AS mean, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS var FROM nw, nn GROUP BY feature, n),
fa AS (SELECT feature, round((var + 1e-10) / (mean + 1e-10), 9) AS fano FROM mom ORDER BY fano DESC, feature LIMIT 20),
cov AS (SELECT obs, sum(value) AS coverage FROM nw GROUP BY 1),
v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, CASE WHEN vec_id % 4 = 0 THEN label::VARCHAR END AS label FROM embeddings),
ring AS (SELECT DISTINCT least(id, id * id % 101) AS src, greatest(id, id * id % 101) AS dst FROM v WHERE id <> id * id % 101),
pt AS (SELECT id, id % 7 AS comm FROM v),
inn AS (SELECT x.comm, count(*) AS e FROM ring r JOIN pt x ON r.src = x.id JOIN pt y ON r.dst = y.id WHERE x.comm = y.comm GROUP BY 1),
deg AS (SELECT comm, count(*) AS k FROM (SELECT src AS id FROM ring UNION ALL SELECT dst FROM ring) JOIN pt USING (id) GROUP BY 1),
q AS (SELECT comm, count(*)::DOUBLE AS n, coalesce(max(e), 0)::DOUBLE AS e, coalesce(max(k), 0)::DOUBLE AS k, sum(coalesce(max(k), 0)) OVER () / 2.0 AS m, sum(count(*)) OVER () AS nodes FROM pt LEFT JOIN inn USING (comm) LEFT JOIN deg USING (comm) GROUP BY comm)
"""
# Pairs of rows as lists x.v and y.v of doubles.
_DIFF = "list_transform(list_zip(x.v, y.v), lambda p: abs(p[1] - p[2]))"
DIST = {
    "correlation": "1 - list_dot_product(list_transform(x.v, lambda t: t - list_avg(x.v)), list_transform(y.v, lambda t: t - list_avg(y.v))) / sqrt(list_sum(list_transform(x.v, lambda t: (t - list_avg(x.v)) ** 2)) * list_sum(list_transform(y.v, lambda t: (t - list_avg(y.v)) ** 2)))",
    "cosine": "1 - list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))",
    "euclidean": f"sqrt(list_sum(list_transform({_DIFF}, lambda d: d * d)))",
    "minkowski": f"sqrt(list_sum(list_transform({_DIFF}, lambda d: d * d)))",
    "sqeuclidean": f"list_sum(list_transform({_DIFF}, lambda d: d * d))",
    "cityblock": f"list_sum({_DIFF})",
    "chebyshev": f"list_max({_DIFF})",
    "canberra": "list_sum(list_transform(list_zip(x.v, y.v), lambda p: CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END))",
    "braycurtis": f"list_sum({_DIFF}) / list_sum(list_transform(list_zip(x.v, y.v), lambda p: abs(p[1] + p[2])))",
}


def _near(metric: str, where: str = "true", limit: float | None = None, k: int = 5, name: str = "kn") -> str:
    cut = f"WHERE dist <= {limit}" if limit is not None else ""
    return f"""{name}_d AS (SELECT x.id AS src, y.id AS dst, round({DIST[metric]}, 9) AS dist FROM v x JOIN v y ON x.id <> y.id AND {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM {name}_d {cut}) WHERE rank <= {k})"""


_KN = "SELECT src, dst, round(dist, 6) AS dist, rank FROM kn"
_EXT = "x.label IS NULL AND y.label IS NOT NULL"
_BACK = "x.label IS NOT NULL AND y.label IS NULL"
_EDGES = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({}) WHERE src <> dst"
_GA = (
    ", f AS (SELECT label, min(id) AS src FROM v WHERE label IS NOT NULL GROUP BY 1), "
    + _near("correlation", "x.id IN (SELECT src FROM f) AND y.label IS NULL", 0.9, 3, "ko")
    + ", "
    + _near("correlation", "x.label IS NULL", 0.9)
    + " "
    + _EDGES.format("SELECT src, dst FROM kn UNION ALL SELECT m.id, ko.dst FROM ko JOIN f USING (src) JOIN v m ON m.label = f.label UNION ALL SELECT x.id, y.id FROM v x JOIN v y ON x.label = y.label AND x.id < y.id")
)
SQL: dict[str, str] = {
    "average_landmark": "SELECT label, feature, round(total / n_cells, 6) AS mean, n_cells FROM sums JOIN cnt USING (label)",
    "label_counts": "SELECT label, n_cells FROM cnt",
    "stratified_sample_counts": "SELECT label, least(n_cells, 20) AS n FROM cnt",
    "label_filter": "SELECT obs, label FROM o WHERE label IN ('BUILDING', 'MACHINERY')",
    "combine_keep_first": "SELECT label, feature, round(mean, 6) AS mean, n_cells, dataset FROM both_atlases WHERE feature IN (SELECT feature FROM sums)",
    "combine_union": "SELECT label, feature, round(mean, 6) AS mean, n_cells, dataset FROM both_atlases",
    "combine_intersection": "SELECT label, feature, round(mean, 6) AS mean, n_cells, dataset FROM both_atlases WHERE feature IN (SELECT feature FROM sums) AND feature IN (SELECT feature FROM sums_b)",
    "feature_overlap": "SELECT feature FROM expr_b INTERSECT SELECT feature FROM nw",
    "markers_unweighted_rest": "SELECT label, feature, round(fold, 6) AS fold, rank FROM mu WHERE rank <= 10",
    "markers_cell_weighted_rest": "SELECT label, feature, round(fold_w, 6) AS fold, rank FROM mw WHERE rank <= 10",
    "similar_label_pairs": "SELECT a, b, round(dist, 6) AS dist FROM pr",
    "pairwise_markers": "SELECT a, b, feature, round(fold, 6) AS fold, rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY fold DESC, feature) AS rank FROM pm) WHERE rank <= 10",
    "feature_mean_var": "SELECT feature, round(mean, 6) AS mean, round(var, 6) AS var FROM mom",
    "overdispersed_topn": "SELECT feature, round(fano, 6) AS fano FROM fa",
    "selected_features": "SELECT feature FROM (SELECT feature FROM mu WHERE rank <= 10 UNION SELECT feature FROM fa) WHERE feature IN (SELECT feature FROM nw) AND feature IN (SELECT feature FROM a)",
    "coverage": "SELECT obs, round(coverage, 6) AS coverage FROM cov",
    "normalise_offset": "SELECT obs, feature, round(1e6 * value / (coverage + 0.1), 6) AS value FROM nw JOIN cov USING (obs)",
    "normalise_guarded": "SELECT obs, feature, round(1e6 * value / CASE WHEN coverage = 0 THEN 1 ELSE coverage END, 6) AS value FROM nw JOIN cov USING (obs)",
    "log_pseudocount": "SELECT obs, feature, round(log10(1e6 * value / (coverage + 0.1) + 0.1), 6) AS value FROM nw JOIN cov USING (obs)",
    "log1p10": "SELECT obs, feature, round(ln(1 + 1e6 * value / coverage) / ln(10), 6) AS value FROM nw JOIN cov USING (obs)",
    "weighted_moments": "SELECT pos, round(s / n, 6) AS mean, round(sqrt(greatest(q / n - (s / n) ** 2, 0)), 6) AS sd FROM (SELECT pos, sum(w) AS n, sum(w * x) AS s, sum(w * x * x) AS q FROM (SELECT (id % 5 + 1)::DOUBLE AS w, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v) GROUP BY pos)",
    "standardise": "SELECT id, pos, round(CASE WHEN sd < 1e-12 THEN 0 ELSE (x - mean) / sd END, 6) AS x FROM (SELECT id, pos, x, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd FROM (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v) WINDOW w AS (PARTITION BY pos))",
    "replicate_by_size": "SELECT label, replica, label || '_' || replica AS name FROM (SELECT label, unnest(range(1, n_cells + 1)) AS replica FROM cnt)",
    "knn_external": "," + _near("correlation", _EXT, 0.9) + _KN,
    "knn_out_of_atlas": ", f AS (SELECT label, min(id) AS src FROM v WHERE label IS NOT NULL GROUP BY 1), "
    + _near("correlation", "x.id IN (SELECT src FROM f) AND y.label IS NULL", 0.9, 3, "ko")
    + " SELECT label, src, dst, round(dist, 6) AS dist, rank FROM ko JOIN f USING (src)",
    "replica_clique": "SELECT x.id AS src, y.id AS dst FROM v x JOIN v y ON x.label = y.label AND x.id < y.id",
    "combine_prefixed_names": "SELECT DISTINCT label AS obs, dataset FROM both_atlases",
    "weighted_covariance": ", u AS (SELECT id, (id % 5 + 1)::DOUBLE AS w, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v) "
    "SELECT p.pos AS a, q.pos AS b, round((sum(p.w * p.x * q.x) - sum(p.w * p.x) * sum(p.w * q.x) / sum(p.w)) / (sum(p.w) - 1), 6) AS cov FROM u p JOIN u q ON p.id = q.id AND p.pos <= q.pos GROUP BY 1, 2",
    **{name: f"SELECT x.id AS src, y.id AS dst, round({DIST['sqeuclidean']}, 5) AS dist FROM v x JOIN v y ON y.id = x.id + 1" for name in ("pca_distances", "pca_weighted_distances")},
    "label_agreement": "," + _near("correlation", _EXT, 0.9, 1) + ", b AS (SELECT y.label AS annotation, e.label::VARCHAR AS label FROM kn JOIN v y ON y.id = kn.dst JOIN embeddings e ON e.vec_id = kn.src WHERE e.label IS NOT NULL) "
    "SELECT count(*) AS n, count(*) FILTER (annotation = label) AS agree, round(count(*) FILTER (annotation = label) / count(*), 6) AS share FROM b",
    "knn_external_mutual": "," + _near("correlation", _EXT, 0.9) + "," + _near("correlation", _BACK, 0.9, 5, "kb") + _KN + " WHERE EXISTS (SELECT 1 FROM kb WHERE kb.src = kn.dst AND kb.dst = kn.src)",
    "graph_average": _GA,
    "graph_subsample": "," + _near("correlation", "true", 0.9) + "," + _near("correlation", _EXT, 0.9, 3, "kx") + _EDGES.format("SELECT src, dst FROM kn UNION ALL SELECT src, dst FROM kx"),
    "external_graph_edges": "SELECT src, dst FROM ring",
    "initial_partition": "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS comm, true AS pinned FROM v WHERE label IS NOT NULL UNION ALL SELECT id, row_number() OVER (ORDER BY id) - 1 + (SELECT count(DISTINCT label) FROM v), false FROM v WHERE label IS NULL",
    "partition_quality_cpm": "SELECT round(sum(e - 0.01 * n * (n - 1) / 2), 6) AS quality FROM q",
    "partition_quality_modularity": "SELECT round(sum(e - k * k / (4 * m)), 6) AS quality FROM q",
    "partition_quality_rbc": "SELECT round(sum(e - 0.01 * k * k / (4 * m)), 6) AS quality FROM q",
    "partition_quality_rber": "SELECT round(sum(e - 0.01 * (2 * m / (nodes * (nodes - 1))) * n * (n - 1) / 2), 6) AS quality FROM q",
    **{
        name: ", c AS (SELECT cluster, list(x ORDER BY pos) AS v FROM (SELECT (id % 9)::VARCHAR AS cluster, pos, avg(x) AS x FROM (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v WHERE id >= 6) GROUP BY 1, 2) GROUP BY 1), "
        f"d AS (SELECT x.cluster, 'L' || y.id AS label, round({DIST[metric]}, 9) AS dist FROM c x, (SELECT * FROM v WHERE id < 6) y) "
        "SELECT cluster, label, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, label) AS r FROM d) WHERE r = 1"
        for name, metric in (("closest_label", "euclidean"), ("closest_subsample", "correlation"))
    },
    **{f"knn_{m}": "," + _near(m) + _KN for m in DIST},
    "partition_quality_significance": ", d AS (SELECT e, n * (n - 1) / 2 AS pairs, 2 * m / (nodes * (nodes - 1)) AS p FROM q) SELECT round(sum(CASE WHEN pairs = 0 THEN 0 ELSE pairs * "
    "(CASE WHEN e > 0 THEN e / pairs * ln(e / pairs / p) ELSE 0 END + CASE WHEN e < pairs THEN (1 - e / pairs) * ln((1 - e / pairs) / (1 - p)) ELSE 0 END) END), 6) AS quality FROM d",
    "partition_quality_surprise": ", d AS (SELECT sum(e) / any_value(m) AS s, sum(n * (n - 1) / 2) / any_value(nodes * (nodes - 1) / 2) AS p, any_value(m) AS m FROM q) "
    "SELECT round(m * (CASE WHEN s > 0 THEN s * ln(s / p) ELSE 0 END + CASE WHEN s < 1 THEN (1 - s) * ln((1 - s) / (1 - p)) ELSE 0 END), 6) AS quality FROM d",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    found = {name: PRE + sql for name, sql in SQL.items()}
    for part in ("expr", "sums", "prof", "mk", "mom"):  # each is read several times here
        found["selected_features"] = found["selected_features"].replace(f"{part} AS (", f"{part} AS MATERIALIZED (", 1)
    return found
