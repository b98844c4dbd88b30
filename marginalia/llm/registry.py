"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from marginalia.llm import (
    block_knn, bpe_codec, chosen_path, code_refinement, disclosure, exact_dedup, language_id, packing, quality,
    token_counts, toxicity, warc, whitening,
)

QUERIES = {
    "op1_ngram_jaccard_join": chosen_path.op1_ngram_jaccard_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_warc_archives": warc.op3_warc_archives,
    "op4_block_knn": block_knn.op4_block_knn,
    "op5_language_id": language_id.op5_language_id,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_disclosure": disclosure.op8_disclosure,
    "op9_packing": packing.op9_packing,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op11_whitening": whitening.op11_whitening,
    "op12_quality": quality.op12_quality,
    "op13_code_refinement": code_refinement.op13_code_refinement,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_warc_archives": warc.ORACLE,
    "op4_block_knn": block_knn.ORACLE,
    "op13_code_refinement": code_refinement.ORACLE,
}
