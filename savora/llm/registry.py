"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from savora.llm import bpe, conversation_repair, embedding_dedup, exact_dedup, html_extract, minhash, mixing, quality, sharding, substring_dedup, topk_search, url_filter, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_minhash": minhash.op3_minhash,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_topk_search": topk_search.op13_topk_search,
}
SQL = {
    "op3_minhash": minhash.OP3_SQL,
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op13_topk_search": topk_search.OP13_SQL,
}
