"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from drawlake.llm import exact_dedup, kmeans, knn_join, language_id, lexical_search, line_crf, mixing, ngram_join, packing, quality_rules, secret_scan, token_files, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_quality": line_crf.op5_line_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_files": token_files.op9_token_files,
    "op10_language_id": language_id.op10_language_id,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_exact_knn": knn_join.op12_exact_knn,
    "op13_kmeans": kmeans.op13_kmeans,
}
ORACLES = {
    "op2_secret_scan": secret_scan.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_exact_knn": knn_join.SQL,
    "op13_kmeans": kmeans.SQL,
}
