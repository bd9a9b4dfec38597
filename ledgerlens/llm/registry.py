"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from ledgerlens.llm import alignment, decontaminate, exact_dedup, langid, line_dedup, lm_score, mixing, pieces, secrets, simhash, toxicity, vector_codes, wavelet

QUERIES = {
    "op1_secret_crf": secrets.op1_secret_crf,
    "op2_spaced_seeds": decontaminate.op2_spaced_seeds,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_stupid_backoff": lm_score.op5_stupid_backoff,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pivotal_mix": mixing.op7_pivotal_mix,
    "op8_language_id": langid.op8_language_id,
    "op9_wavelet_shards": wavelet.op9_wavelet_shards,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_product_codes": vector_codes.op11_product_codes,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_piece_encoding": pieces.op13_piece_encoding,
}

SQL = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_stupid_backoff": lm_score.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_product_codes": vector_codes.ORACLE,
}
