"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from gatewarden.llm import exact, mixing, ranked, resample, secrets, simhash, suffixes, tokens, topk, toxicity, urls, winnow

QUERIES = {
    "op10_mixing": mixing.op10_mixing,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_resampling": resample.op13_resampling,
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": winnow.op3_decontaminate,
    "op4_top_scores": topk.op4_top_scores,
    "op5_token_output": tokens.op5_token_output,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_url_filter": urls.op7_url_filter,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_simhash": simhash.op9_simhash,
}

SQL: dict[str, str] = {
    "op4_top_scores": topk.SQL,
    "op7_url_filter": urls.SQL,
    "op10_mixing": mixing.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_exact_dedup": exact.SQL,
}
