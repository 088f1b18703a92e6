"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_decontamination
from .jaccard_join import op6_jaccard_join
from .line_dedup import op9_line_dedup
from .oracle_sql import JACCARD_JOIN, QUALITY_RULES, SUBSTRING_DEDUP, SUFFIX_DEDUP
from .packing import op7_packing
from .pii import op8_pii
from .quality_rules import op5_quality_rules
from .secret_scan import op10_secret_scan
from .suffix_dedup import op1_suffix_dedup
from .substring_dedup import op3_substring_dedup
from .toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_toxicity, op3_substring_dedup, op4_decontamination, op5_quality_rules, op6_jaccard_join, op7_packing, op8_pii, op9_line_dedup, op10_secret_scan]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the exact operators; models, alignments, searches and packings are compared with plain versions in tests."""
    return {"op1_suffix_dedup": SUFFIX_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP, "op5_quality_rules": QUALITY_RULES, "op6_jaccard_join": JACCARD_JOIN}
