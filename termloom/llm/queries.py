"""Queries of the training-data operators and the SQL that states some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, jaccard, katz, langid, lines, mixing, secrets, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op,
        "op2_katz": katz.op,
        "op3_fuzzy_lines": lines.op,
        "op4_string_kernel": langid.op,
        "op5_jaccard_join": jaccard.op,
        "op6_benchmark_matches": decontaminate.op,
        "op7_warc_zstd": warc.op,
        "op8_source_mix": mixing.op,
        "op9_secrets": secrets.op,
        "op10_fertility": fertility.op,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_katz": katz.SQL, "op5_jaccard_join": jaccard.SQL, "op7_warc_zstd": warc.SQL, "op8_source_mix": mixing.sql()}
