"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import bpe, collocations, embedding_dedup, exact_dedup, html_content, jaccard_join, language_id, mixing, sharding, spelling, substring_dedup, token_counts, topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_html_content": html_content.op2_html_content,
    "op3_language_id": language_id.op3_language_id,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_bpe_encode_decode": bpe.op5_bpe_encode_decode,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_kd_tree_shards": sharding.op9_kd_tree_shards,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_embedding_near_dedup": embedding_dedup.op12_embedding_near_dedup,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op12_embedding_near_dedup": embedding_dedup.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
