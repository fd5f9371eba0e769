"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import chat, decontam, exact, fim, licenses, minhash, negatives, packing, pii, quality, substring, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_substring": substring.op2_substring,
        "op3_pii": pii.op3_pii,
        "op4_packing": packing.op4_packing,
        "op5_exact": exact.op5_exact,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_minhash": minhash.op7_minhash,
        "op8_quality": quality.op8_quality,
        "op9_decontam": decontam.op9_decontam,
        "op10_token_counts": tokens.op10_token_counts,
        "op11_licenses": licenses.op11_licenses,
        "op12_negatives": negatives.op12_negatives,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op2_substring": substring.OP2_SQL, "op5_exact": exact.OP5_SQL, "op9_decontam": decontam.OP9_SQL, "op12_negatives": negatives.OP12_SQL, "op13_fim": fim.OP13_SQL}
