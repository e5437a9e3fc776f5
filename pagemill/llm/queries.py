"""Queries over the training-data operators: name -> callable, and their SQL where it exists."""

from __future__ import annotations

from pagemill.llm import hilbert_ann, line_dedup, lm_score, near_dup, order_minhash, packing, phrase_mining, quality, secret_scan, sentence_pieces, spelling, substring_dedup, warc_store

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality": quality.query,
    "op3_sentence_pieces": sentence_pieces.query,
    "op4_packing": packing.query,
    "op5_secret_scan": secret_scan.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_near_dup": near_dup.query,
    "op8_lm_score": lm_score.query,
    "op9_hilbert_ann": hilbert_ann.query,
    "op10_warc_store": warc_store.query,
    "op11_order_minhash": order_minhash.query,
    "op12_phrase_mining": phrase_mining.query,
    "op13_spelling": spelling.query,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_near_dup": near_dup.SQL,
    "op10_warc_store": warc_store.SQL,
    "op12_phrase_mining": phrase_mining.SQL,
    "op13_spelling": spelling.SQL,
}
