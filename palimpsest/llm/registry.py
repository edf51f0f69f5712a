"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import bpe, fingerprint, hamming, hard_negatives, lexical_search, line_dedup, media, mixing, near_dedup, passage_dedup, quality, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_hamming_topk": hamming.query,
        "op2_minhash_near_dedup": near_dedup.query,
        "op3_kneser_ney_quality": quality.query,
        "op4_compact_windows": passage_dedup.query,
        "op5_bpe": bpe.query,
        "op6_suffix_array_dedup": suffix_dedup.query,
        "op7_mixing": mixing.query,
        "op8_ogg_media": media.query,
        "op9_warc": warc.query,
        "op10_line_dedup": line_dedup.query,
        "op11_multiset_fingerprint": fingerprint.query,
        "op12_angular_hard_negatives": hard_negatives.query,
        "op13_shared_lexical_search": lexical_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hamming_topk": hamming.ORACLE,
        "op2_minhash_near_dedup": near_dedup.ORACLE,
        "op9_warc": warc.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op12_angular_hard_negatives": hard_negatives.ORACLE,
        "op13_shared_lexical_search": lexical_search.ORACLE,
    }
