"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.audio import op4_audio_features
from gleaner.llm.curriculum import OP5_SQL, op5_curriculum
from gleaner.llm.line_dedup import op8_line_dedup
from gleaner.llm.pieces import op6_sentencepiece
from gleaner.llm.quality import OP3_SQL, op3_quality_rules
from gleaner.llm.simhash import op10_simhash_near_dedup
from gleaner.llm.token_shards import op9_token_shards
from gleaner.llm.toxicity import op2_toxicity
from gleaner.llm.url_filter import OP7_SQL, op7_url_filter
from gleaner.llm.warc import OP1_SQL, op1_warc_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_audio_features": op4_audio_features,
    "op5_curriculum": op5_curriculum,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_shards": op9_token_shards,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_chunks": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op5_curriculum": OP5_SQL,
    "op7_url_filter": OP7_SQL,
}
