"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, compact_windows, decontamination, fill_in_middle, html_text, inverted_multi_index, jaccard_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup, suffix_tree_lm


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_packing": packing.op2_packing,
        "op3_lm_scoring": suffix_tree_lm.op3_lm_scoring,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_html_text": html_text.op7_html_text,
        "op8_sharding": sharding.op8_sharding,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_compact_windows": compact_windows.op10_compact_windows,
        "op11_inverted_multi_index": inverted_multi_index.op11_inverted_multi_index,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": fill_in_middle.SQL, "op13_collocations": collocations.SQL}
