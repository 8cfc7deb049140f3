"""Queries of the training-data operators. None has a SQL text unless ORACLES names it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiewright.llm import decontaminate, divergence, negatives
from tiewright.llm.bpe import op3_bpe_roundtrip
from tiewright.llm.fingerprint import op9_document_fingerprints
from tiewright.llm.language_model import op6_lm_score
from tiewright.llm.license_scan import op1_license_scan
from tiewright.llm.personal import op11_personal_data
from tiewright.llm.secrets import op7_secret_scan
from tiewright.llm.simhash import op10_simhash_components
from tiewright.llm.token_counts import op5_token_counts
from tiewright.llm.token_store import op8_token_store
from tiewright.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_toxicity, op3_bpe_roundtrip, decontaminate.op4_benchmark_decontamination, op5_token_counts,
        op6_lm_score, op7_secret_scan, op8_token_store, op9_document_fingerprints, op10_simhash_components,
        op11_personal_data, divergence.op12_source_divergence, negatives.op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {"op4_benchmark_decontamination": decontaminate.SQL, "op12_source_divergence": divergence.SQL, "op13_hard_negatives": negatives.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
