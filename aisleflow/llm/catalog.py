"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import q_media, q_models, q_pairs, q_pii, q_runs, q_scan, q_text, q_vectors

QUERIES = {
    "op1_bpe": q_text.op1_bpe,
    "op2_language_id": q_models.op2_language_id,
    "op3_secrets": q_scan.op3_secrets,
    "op4_topk": q_scan.op4_topk,
    "op5_toxicity": q_models.op5_toxicity,
    "op6_minhash": q_pairs.op6_minhash,
    "op7_packing": q_text.op7_packing,
    "op8_pii": q_pii.op8_pii,
    "op9_media": q_media.op9_media,
    "op10_quality": q_scan.op10_quality,
    "op11_whitening": q_vectors.op11_whitening,
    "op12_runs": q_runs.op12_runs,
    "op13_simhash": q_pairs.op13_simhash,
}

SQL: dict[str, str] = {"op4_topk": q_scan.SQL_OP4, "op6_minhash": q_pairs.SQL_OP6}
