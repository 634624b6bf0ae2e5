"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, mixing, pii, quality_mil, quality_rules, secrets, simhash, substring_dedup, toxicity
from .sql import ORACLES

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        bpe.op2_bpe,
        toxicity.op3_toxicity,
        quality_rules.op4_quality_rules,
        mixing.op5_mixing,
        secrets.op6_secrets,
        quality_mil.op7_quality_mil,
        simhash.op8_simhash,
        exact_dedup.op9_exact_dedup,
        pii.op10_pii,
    )
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
