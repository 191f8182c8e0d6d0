"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from wayfold.llm import bpe, exact, lengths, lines, mixing, quality, secrets, simhash, substrings, topk

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_top_k": topk.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_exact_dedup": exact.query,
    "op5_quality": quality.query,
    "op6_bpe_round_trip": bpe.query,
    "op7_secret_scan": secrets.query,
    "op8_substring_dedup": substrings.query,
    "op9_token_lengths": lengths.query,
    "op10_line_dedup": lines.query,
}

ORACLES = {
    "op2_top_k": topk.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op10_line_dedup": lines.ORACLE,
}
