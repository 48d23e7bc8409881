"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import op9_benchmark_decontamination
from tessera.llm.licences import op8_license_scan, op8_sql
from tessera.llm.mixing import op3_source_mix
from tessera.llm.near_dedup import op7_minhash_near_dedup
from tessera.llm.quality import op4_quality_classifier
from tessera.llm.substring_dedup import op1_substring_dedup
from tessera.llm.suffix_dedup import op10_suffix_array_dedup
from tessera.llm.token_counts import op6_token_counts
from tessera.llm.topk import op2_exact_topk
from tessera.llm.warc import OP5_SQL, op5_warc

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_substring_dedup,
        op2_exact_topk,
        op3_source_mix,
        op4_quality_classifier,
        op5_warc,
        op6_token_counts,
        op7_minhash_near_dedup,
        op8_license_scan,
        op9_benchmark_decontamination,
        op10_suffix_array_dedup,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op5_warc": OP5_SQL, "op8_license_scan": op8_sql()}
