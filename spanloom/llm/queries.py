"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lm_scoring, substring_dedup, warc
from .byte_bpe import op10_byte_bpe
from .decontamination import op7_decontamination
from .hnsw import op8_hnsw
from .html_main_text import op1_html_main_text
from .lm_scoring import op9_lm_scoring
from .sharding import op2_sharding
from .simhash import op5_simhash
from .substring_dedup import op4_substring_dedup
from .toxicity import op3_toxicity
from .warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_main_text": op1_html_main_text,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_simhash": op5_simhash,
        "op6_warc": op6_warc,
        "op7_decontamination": op7_decontamination,
        "op8_hnsw": op8_hnsw,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.ORACLE, "op6_warc": warc.ORACLE, "op9_lm_scoring": lm_scoring.ORACLE}
