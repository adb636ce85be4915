"""The registered queries of this subpackage and, where SQL can express one, the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dedup, langid, mixing, passages, quality, sharding, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1,
    "op2_warc": warc.op2,
    "op3_near_duplicates": dedup.op3,
    "op4_quality": quality.op4,
    "op5_language": langid.op5,
    "op6_tokens": tokens.op6,
    "op7_mixing": mixing.op7,
    "op8_toxicity": toxicity.op8,
    "op9_passages": passages.op9,
    "op10_decontamination": decontaminate.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.ORACLE,
}
