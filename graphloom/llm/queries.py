"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat_format, decontaminate, divergence, exact_dedup, jaccard_join, langid, line_dedup, packing, pii, quality, records, spelling, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_pii_surrogates": pii.op4_pii_surrogates,
        "op5_packing": packing.op5_packing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_quality": quality.op7_quality,
        "op8_language_id": langid.op8_language_id,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_spelling": spelling.op11_spelling,
        "op12_divergence": divergence.op12_divergence,
        "op13_records": records.op13_records,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_chat_format": chat_format.OP3_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
    }
