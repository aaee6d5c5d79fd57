"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from nearkey.llm import divergence, line_dedup, line_runs, mixing, neighbours, packing, secrets, simhash, suffix_dedup, toxicity, vector_dedup, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_nearest": neighbours.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_mixing": mixing.query,
    "op6_warc": warc.query,
    "op7_vector_dedup": vector_dedup.query,
    "op8_secret_scan": secrets.query,
    "op9_best_fit_packing": packing.query,
    "op10_simhash": simhash.query,
    "op11_whitening": whitening.query,
    "op12_divergence": divergence.query,
    "op13_line_runs": line_runs.query,
}

ORACLE_SQL = {
    "op2_nearest": neighbours.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_vector_dedup": vector_dedup.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_line_runs": line_runs.ORACLE,
}
