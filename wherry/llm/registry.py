"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wherry.llm import op6_warc, op10_decontaminate
from wherry.llm.op1_url_filter import op1_url_filter
from wherry.llm.op2_html import op2_html
from wherry.llm.op3_language import op3_language_id
from wherry.llm.op4_toxicity import op4_toxicity
from wherry.llm.op5_sentencepiece import op5_sentencepiece
from wherry.llm.op7_line_dedup import op7_line_dedup
from wherry.llm.op8_winnowing import op8_winnowing
from wherry.llm.op9_simhash import op9_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_html": op2_html,
        "op3_language_id": op3_language_id,
        "op4_toxicity": op4_toxicity,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_warc": op6_warc.op6_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_winnowing": op8_winnowing,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the others are tested against brute force."""
    return {
        "op6_warc": op6_warc.ORACLE_SQL,
        "op10_decontaminate": op10_decontaminate.ORACLE_SQL,
    }
