"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import ann, chat, jaccard, langid, mixing, packing, quality, substring_dedup, topk, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        url_filters.op2_url_filters,
        topk.op3_exact_topk,
        chat.op4_preference_chat,
        langid.op5_language_id,
        jaccard.op6_ngram_jaccard,
        packing.op7_best_fit_packing,
        mixing.op8_mixing,
        quality.op9_quality,
        ann.op10_ann,
    )
}

#: The others learn models, hash, tokenize or round with a carry: tests hold them against brute force.
ORACLE_SQL = {"op2_url_filters": url_filters.SQL, "op3_exact_topk": topk.SQL, "op4_preference_chat": chat.SQL, "op6_ngram_jaccard": jaccard.SQL}
