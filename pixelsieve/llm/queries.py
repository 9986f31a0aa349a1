"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelsieve.llm import bpe, chat, exact_dedup, fingerprints, jaccard_join, language_id, packing, repeated_text, secrets, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_sharding": sharding.op2_sharding,
        "op3_repeated_text": repeated_text.op3_repeated_text,
        "op4_packing": packing.op4_packing,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_language_id": language_id.op6_language_id,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_bpe": bpe.op8_bpe,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.OP1_SQL,
        "op2_sharding": sharding.OP2_SQL,
        "op5_jaccard_join": jaccard_join.OP5_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_secrets": secrets.OP10_SQL,
    }
