"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import digest, flac, html, jaccard, langid, licenses, mixing, packing, pii, quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_flac_media": flac.op1_flac_media,
        "op2_improbable_features": digest.op2_improbable_features,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_mixing": mixing.op5_mixing,
        "op6_html_extraction": html.op6_html_extraction,
        "op7_license_scans": licenses.op7_license_scans,
        "op8_pii_pseudonyms": pii.op8_pii_pseudonyms,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard.OP3_SQL, "op5_mixing": mixing.OP5_SQL}
