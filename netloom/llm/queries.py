"""Queries of this subpackage for the driver: name -> callable, and their SQL."""

from __future__ import annotations

from netloom.llm import bpe, exact_dedup, html_diff, langid, line_dedup, media, minhash, mixing, sharding, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1,
        "op2_html_diff": html_diff.op2,
        "op3_png_media": media.op3,
        "op4_exact_dedup": exact_dedup.op4,
        "op5_line_dedup": line_dedup.op5,
        "op6_mix_entropy": mixing.op6,
        "op7_langid_kernel": langid.op7,
        "op8_bag_minhash": minhash.op8,
        "op9_toxicity_nearest": toxicity.op9,
        "op10_sharding_table": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op10_sharding_table": sharding.op10_sql()}
