"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from tallyframe.llm import (
    bpe, clustering, decontamination, embedding_dedup, langid, lm_scoring, near_dedup, quality, secrets, spelling, substring_dedup, topk_search, toxicity,
)

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_compression_toxicity": toxicity.op4_compression_toxicity,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_ppm_language": langid.op6_ppm_language,
    "op7_block_topk_search": topk_search.op7_block_topk_search,
    "op8_masked_lm_scoring": lm_scoring.op8_masked_lm_scoring,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_repeated_substrings": substring_dedup.op10_repeated_substrings,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_embedding_near_dedup": embedding_dedup.op12_embedding_near_dedup,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}
ORACLES: dict[str, str] = {
    "op7_block_topk_search": topk_search.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
