"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat, clustering, decontaminate, importance, lm, mixing, neardup, oracles, packing, secrets, substrings, topk, toxicity, warc


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_setsketch_neardup": neardup.op4_setsketch_neardup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_lm_score": lm.op6_lm_score,
        "op7_exact_topk": topk.op7_exact_topk,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_warc_archive": warc.op9_warc_archive,
        "op10_perspective_rotation": chat.op10_perspective_rotation,
        "op11_centroid_clusters": clustering.op11_centroid_clusters,
        "op12_source_mixing": mixing.op12_source_mixing,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql():
    return {
        "op2_substring_dedup": oracles.SUBSTRINGS,
        "op4_setsketch_neardup": oracles.NEAR_DUPLICATES,
        "op7_exact_topk": topk.OP7_SQL,
        "op8_decontaminate": oracles.OVERLAPS,
        "op9_warc_archive": warc.OP9_SQL,
        "op10_perspective_rotation": chat.OP10_SQL,
        "op11_centroid_clusters": clustering.OP11_SQL,
        "op12_source_mixing": mixing.OP12_SQL,
        "op13_importance_resampling": importance.OP13_SQL,
    }
