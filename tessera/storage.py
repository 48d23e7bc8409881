"""Intermediate tables in a folder that all executors share.

They cut lineage, so plans stay small and a lost executor costs no more than the tasks it had.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, as in tests, one of our own where that is unset.

    On a cluster an unset folder is an error: executors can't see each other's own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one; what is in it goes when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; the folder belongs to the cluster's clean-up then
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later job reads: all that was made of them is written itself."""
    for table in tables:
        _delete(table.sparkSession, table._written_to)
