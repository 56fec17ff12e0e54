"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from quirespark.llm import chat, divergence, embedup, leaks, linededup, lmscore, mixing, neardup, pieces, quality, quantiles, tokencount, urlfilter

QUERIES = {
    "op1_lm_scoring": lmscore.op1_lm_scoring,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_token_counts": tokencount.op6_token_counts,
    "op7_minhash_neardup": neardup.op7_minhash_neardup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_embedding_neardup": embedup.op10_embedding_neardup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_decontamination": leaks.op12_decontamination,
    "op13_quantile_summaries": quantiles.op13_quantile_summaries,
}
SQL = {
    "op3_mixing": mixing.SQL,
    "op4_line_dedup": linededup.SQL,
    "op5_quality_rules": quality.SQL,
    "op8_chat_formatting": chat.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_decontamination": leaks.SQL,
}
