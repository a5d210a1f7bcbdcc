"""Queries of the training-data operators and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_token_alignment
from .bpe import op9_bpe
from .chunked_bpe import op13_byte_bpe
from .embeddings import op5_embedding_near_dups
from .language import op4_language_id
from .licenses import op8_license_scan
from .lines import op7_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import op3_mixing
from .quality import OP6_SQL, op6_quality_rules
from .sharding import op1_sharding
from .simhash import op2_simhash
from .token_tables import op10_token_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_embedding_near_dups": op5_embedding_near_dups,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_bpe": op9_bpe,
    "op10_token_tables": op10_token_tables,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op11_merkle_manifest": OP11_SQL}
