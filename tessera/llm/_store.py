"""Row keys, batch sizes, and pass-through of columns the operators don't use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.storage import discard, new_folder

__all__ = ["REST", "ROW", "discard", "file_key", "keyed", "new_folder", "original", "quoted", "releasing", "small_batches", "written"]
ROW = "_row"
REST = "_rest"
#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20
#: Rows of a file, where a table's size is known beforehand.
FILE_ROWS = 50_000


def small_batches(spark: SparkSession) -> None:
    """From now on this session gives Python workers Arrow batches of a few megabytes, instead of 64.

    A worker and the JVM's side of it both hold a batch or two, for each core.  A row larger than that is a batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, made and read with small Arrow batches.

    ``rows``: about how many there are.  The partitions then share tasks, two a core or as many as files of
    FILE_ROWS rows take: where Hadoop has no native library, each file costs its executor several child processes.
    """
    small_batches(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    return storage.written(df, name)


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(rows: Rows) -> Rows:
    """``rows``, for mapInArrow, giving the memory that it has freed back to the system at its end.

    A worker waits for its next task with all that its allocators keep, beside the workers of other stages.
    """

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


#: Bits of a file's hash and of a row's place in its file, together the key of a row.
FILE_BITS, PLACE_BITS = 33, 30


def file_key(docs: DataFrame) -> Column | None:
    """A key of each row from its file and its place in it, if ``docs`` does no more than select from files.

    The seed is such that no two files have one hash; None where there is no such key.
    """
    if "_metadata" in docs.columns:
        return None
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    while plan.nodeName() != "LogicalRelation":
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias") or plan.children().size() != 1:
            return None
        plan = plan.children().head()
    try:
        files = docs.groupBy("_metadata.file_path").agg(F.max("_metadata.row_index").alias("most")).collect()  # reads no column; the driver lists the files anyway
    except (AnalysisException, PySparkException):  # no such place in this format
        return None
    if any(r["most"] >= 1 << PLACE_BITS for r in files):
        return None
    names = docs.sparkSession.createDataFrame([(r["file_path"],) for r in files], "p string")
    for seed in range(4):
        number = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c), 64 - FILE_BITS)  # noqa: B023, E731
        if not files or names.select(F.count_distinct(number(F.col("p")))).first()[0] == len(files):
            return F.shiftleft(number(F.col("_metadata.file_path")), PLACE_BITS).bitwiseOR(F.col("_metadata.row_index"))
    return None


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """(_row, doc_id, text [, _rest]): _row tells even repeated rows apart, and is the same in every job.

    It is the file and the place in it where ``docs`` selects from files; any other input is numbered and written
    once, so its numbers don't change with the partitions that a job sees.  ``rest`` adds the struct of the other
    columns for ``original``.
    """
    columns = [quoted(docs, id_col).cast("long").alias("doc_id"), quoted(docs, text_col).cast("string").alias("text")]
    if rest:
        columns.append(F.struct(F.lit(True).alias("_"), *[quoted(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns) if not _is_text(docs, c, text_col)]).alias(REST))
    small_batches(docs.sparkSession)
    key = file_key(docs)
    if key is not None:
        return docs.select(key.alias(ROW), *columns)
    return written(docs.select(F.monotonically_increasing_id().alias(ROW), *columns), "rows")


def _is_text(docs: DataFrame, name: str, text_col: str) -> bool:
    return name == text_col and docs.schema[name].dataType.simpleString() == "string"


def original(df: DataFrame, docs: DataFrame, text_col: str = "text", text: Column | None = None, **instead: Column) -> DataFrame:
    """The columns of ``docs`` from ``text`` and ``_rest`` of ``df``; a new text or other columns if given."""
    out = []
    for i, c in enumerate(docs.columns):
        if c == text_col and text is not None:
            value = text
        elif c in instead:
            value = instead[c]
        else:
            value = F.col("text") if _is_text(docs, c, text_col) else F.col(f"{REST}.c{i}")
        out.append(value.alias(c))
    return df.select(*out)


def quoted(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]
