"""The registered queries of the corpus operators, and their SQL where it can say the same."""

from __future__ import annotations

from orrery.llm import bpe, licenses, mixing, quality, repeats, simhash, tiff, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op2_bpe_decoded": bpe.op2_bpe_decoded,
    "op3_licenses": licenses.op3_licenses,
    "op4_tiff": tiff.op4_tiff,
    "op5_topk": topk.op5_topk,
    "op6_token_counts": bpe.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_repeats": repeats.op10_repeats,
}

SQL = {"op2_bpe_decoded": bpe.DECODED_SQL, "op5_topk": topk.OP5_SQL, "op7_mixing": mixing.OP7_SQL}
