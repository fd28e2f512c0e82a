"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, exact_dedup, fim, langid, licenses, packing, pieces, pii, simhash, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_chat_rotation": chat.op2_chat_rotation,
        "op3_simhash": simhash.op3_simhash,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_language_id": langid.op5_language_id,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_topk": topk.op9_topk,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_personal_data": pii.op12_personal_data,
        "op13_centroid_clusters": clusters.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_chat_rotation": chat.OP2_SQL,
        "op9_topk": topk.OP9_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op11_fill_in_middle": fim.OP11_SQL,
        "op13_centroid_clusters": clusters.OP13_SQL,
    }
