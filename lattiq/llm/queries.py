"""The registered corpus queries and their SQL."""

from __future__ import annotations

from lattiq.llm import (
    compressed_quality,
    conversations,
    decontamination,
    divergence,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    pieces,
    secret_scan,
    topk_search,
    url_filter,
    warc,
)

QUERIES = {
    "op1_exact_topk": topk_search.op1_exact_topk,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_language_id": language_id.op9_language_id,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_compressed_quality": compressed_quality.op13_compressed_quality,
}

ORACLES = {
    "op1_exact_topk": topk_search.ORACLE,
    "op5_html_extraction": html_text.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_warc_revisits": warc.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
