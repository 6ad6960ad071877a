"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bytepairs import op12_byte_bpe
from textloom.llm.fingerprints import op10_fingerprints
from textloom.llm.toxicity import op6_toxicity
from textloom.llm.quality import op1_quality
from textloom.llm.pieces import op2_sentencepiece
from textloom.llm.tokens import op9_token_counts
from textloom.llm.decontamination import op5_decontamination
from textloom.llm.lm import op8_lm_scores
from textloom.llm.secrets import op3_secrets, secrets_sql
from textloom.llm.neardup import op4_near_duplicates
from textloom.llm.lines import op7_line_dedup
from textloom.llm.negatives import negatives_sql, op13_hard_negatives
from textloom.llm.middle import middle_sql, op11_fill_in_middle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_line_dedup": op7_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op3_secrets": op3_secrets,
    "op8_lm_scores": op8_lm_scores,
    "op5_decontamination": op5_decontamination,
    "op9_token_counts": op9_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op1_quality": op1_quality,
    "op6_toxicity": op6_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op3_secrets": secrets_sql(),
    "op11_fill_in_middle": middle_sql(),
    "op13_hard_negatives": negatives_sql(),
}
