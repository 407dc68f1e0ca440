"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, html_extract, langid, licenses, mixing, ngram_join, quality, sentencepiece, topk, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": topk.op1_topk,
        "op10_mixing": mixing.op10_mixing,
        "op5_fingerprints": fingerprint.op5_fingerprints,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_language_id": langid.op8_language_id,
        "page_language_id": langid.page_language_id,
        "op9_quality": quality.op9_quality,
        "op3_sentencepiece": sentencepiece.op3_sentencepiece,
        "op6_license_scan": licenses.op6_license_scan,
        "op4_token_ids": wavelet.op4_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL}
