"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from scriptorium.llm import chat, decontaminate, kmeans, languages, licenses, mixing, neardup, pii, row_patterns, tokens, topk, toxicity, url_filter
from scriptorium.llm.common import table

QUERIES = {
    "op1_pii": lambda spark, d: pii.op1_pii(table(spark, d, "documents")),
    "op2_neardup": lambda spark, d: neardup.op2_neardup(table(spark, d, "documents")),
    "op3_license": lambda spark, d: licenses.op3_license(table(spark, d, "documents")),
    "op4_chat": lambda spark, d: chat.op4_chat(table(spark, d, "conversations")),
    "op5_topk": lambda spark, d: topk.op5_topk(table(spark, d, "embeddings")),
    "op6_tokens": lambda spark, d: tokens.op6_tokens(table(spark, d, "documents")),
    "op7_decontaminate": lambda spark, d: decontaminate.op7_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_urls": lambda spark, d: url_filter.judge_urls(table(spark, d, "pages")),
    "op9_mix": lambda spark, d: mixing.op9_mix(table(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity.op10_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_patterns": lambda spark, d: row_patterns.op11_patterns(table(spark, d, "clicks")),
    "op12_clusters": lambda spark, d: kmeans.op12_clusters(table(spark, d, "embeddings")),
    "op13_languages": lambda spark, d: languages.op13_languages(table(spark, d, "documents")),
}

ORACLE_SQL = {
    "op2_neardup": neardup.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_topk": topk.ORACLE,
    "op8_urls": url_filter.oracle(),
    "op11_patterns": row_patterns.ORACLE,
    "op12_clusters": kmeans.oracle(),
}
