"""Catalogue of landmark sets, their tables, and ingestion of matrices in wide form.

The long form is used throughout: ``expr(obs, feature, value)`` without zeros and ``obs(obs, label)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("average", "subsample")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, url_average, url_subsample) from a tab-separated file with a header; the first column is the name."""
    raw = spark.read.csv(path, sep="\t", header=True)
    first = raw.columns[0]
    return raw.select(F.col(f"`{first}`").alias("name"), F.col("URL_average").alias("url_average"), F.col("URL_subsample").alias("url_subsample"))


def list_atlases(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("name").distinct().orderBy("name")


def fetch_atlas(catalogue: DataFrame, name: str, kind: str = "average", labels: list[str] | None = None) -> DataFrame:
    """The named landmark table, (obs, label, feature, value [, n_cells]), cut to ``labels`` if given."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    row = catalogue.where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"no atlas named {name}")
    return filter_labels(catalogue.sparkSession.read.parquet(row[f"url_{kind}"]), labels)


def filter_labels(table: DataFrame, labels: list[str] | None) -> DataFrame:
    return table if labels is None else table.where(F.col("label").isin(list(labels)))


def fetch_selected(catalogue: DataFrame, selector: str | dict | list, kind: str = "average", join: str = "keep_first") -> DataFrame:
    """Atlases by name, by {atlas_name, cell_types}, or a list of either, combined."""
    from tessera.operators.combine import combine

    items = [selector] if isinstance(selector, (str, dict)) else list(selector)
    if not items:
        raise ValueError("no atlas was asked for")
    wanted: dict[str, list[str] | None] = {}
    for item in items:
        name, labels = (item, None) if isinstance(item, str) else (item["atlas_name"], item.get("cell_types"))
        wanted.setdefault(name, labels)
    tables = [(name, fetch_atlas(catalogue, name, kind, labels)) for name, labels in wanted.items()]
    return tables[0][1] if len(tables) == 1 else combine(tables, join, kind)


def from_wide(wide: DataFrame, feature_col: str) -> DataFrame:
    """(obs, feature, value) of a table with features as rows and one numeric column an observation.

    obs is the column's position, since names may repeat; zeros are left out.
    """
    names = [c for c in wide.columns if c != feature_col]
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("obs"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(names)])
    return wide.select(F.col(feature_col).alias("feature"), F.explode(pairs).alias("p")).select("p.obs", "feature", "p.value").where("value <> 0")


def wide_names(wide: DataFrame, feature_col: str) -> DataFrame:
    """(obs, name): the column that each observation of ``from_wide`` was."""
    names = [c for c in wide.columns if c != feature_col]
    return wide.sparkSession.createDataFrame(list(enumerate(names)), "obs long, name string")
