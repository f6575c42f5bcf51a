"""The registered queries of this subpackage and their SQL."""

from scriptmill.llm import (
    bpe, conversations, decontaminate, jaccard, language, line_dedup, neighbours, pieces, quality, substrings, url_filters,
    warc, whitening)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_language_id": language.op6_language_id,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_bpe": bpe.op8_bpe,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_warc": warc.op10_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_trie": conversations.op12_conversation_trie,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_ngram_jaccard": jaccard.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_warc": warc.SQL,
    "op12_conversation_trie": conversations.SQL,
}
