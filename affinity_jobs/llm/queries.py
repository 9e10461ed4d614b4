"""The corpus operators' queries over the given tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, embed_dedup, hard_negatives, html_text, langid, media, mixing, near_dedup, ngram_lm, prefix_trie, quality, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1,
        "op2_toxicity": toxicity.op2,
        "op3_bpe": bpe.op3,
        "op4_html_text": html_text.op4,
        "op5_langid": langid.op5,
        "op6_lm": ngram_lm.op6,
        "op7_suffix_dedup": suffix_dedup.op7,
        "op8_media": media.op8,
        "op9_mixing": mixing.op9,
        "op10_embed_dedup": embed_dedup.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_quality": quality.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_prefix_trie": prefix_trie.SQL}
