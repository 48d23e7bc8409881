"""A training corpus from raw documents: five stages, each on all that the one before kept.

Quality classifier, near-duplicate removal, removal of repeated byte strings, benchmark decontamination, and
mixing of sources.  All stages but the last return the columns of ``documents``; the last returns what the mix
takes of each document.  Stages take their tables as they come: nulls, empty texts, repeated rows and empty
tables as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import written
from tessera.llm.decontamination import without_contaminated
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import without_near_duplicates
from tessera.llm.quality import fitted, with_scores
from tessera.llm.suffix_dedup import without_repeated_bytes

ACCEPT = 0.7
#: Words of the shortest repeated passage that goes, however few bytes it has.
PASSAGE_WORDS = 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least ACCEPT."""
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model).where(F.col("score") >= ACCEPT).select("_rest.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return without_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 400 bytes or of over 50 words that are anywhere else too; texts that nothing is left of go."""
    return without_repeated_bytes(docs, words=PASSAGE_WORDS, length_col="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the hashed orders and the sketches have no SQL form; the tests hold each stage against plain code.
ORACLE_SQL = None
