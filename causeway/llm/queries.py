"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.llm.byte_bpe import op8_byte_bpe
from causeway.llm.embedding_dedup import op7_embedding_near_dedup
from causeway.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from causeway.llm.language_id import op6_language_id
from causeway.llm.line_dedup import OP3_SQL, op3_line_dedup
from causeway.llm.mixing import OP4_SQL, op4_mix_sources
from causeway.llm.near_dedup import op1_minhash_near_dedup
from causeway.llm.passage_dedup import op9_substring_dedup
from causeway.llm.pii import op10_pii
from causeway.llm.suffix_dedup import op5_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_language_id": op6_language_id,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL}
