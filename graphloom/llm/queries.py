"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, jaccard, langid, lm, media, mixing, repair, suffix, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1,
        "op2_lm_scoring": lm.op2,
        "op3_suffix_dedup": suffix.op3,
        "op4_nearest_neighbours": ann.op4,
        "op5_jaccard_join": jaccard.op5,
        "op6_token_output": repair.op6,
        "op7_url_filter": url_filter.op7,
        "op8_media_columns": media.op8,
        "op9_byte_bpe": bpe.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.OP7_SQL, "op10_mixing": mixing.OP10_SQL}
