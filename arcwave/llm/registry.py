"""The queries of this package and their SQL."""

from __future__ import annotations

from arcwave.llm import embedding_dedup, line_dedup, merkle, ngram_join
from arcwave.llm.decontamination import op7_decontamination
from arcwave.llm.packing import op9_packing
from arcwave.llm.pii import op10_pii
from arcwave.llm.secret_scan import op3_secret_scan
from arcwave.llm.sharding import op6_sharding
from arcwave.llm.substring_dedup import op4_substring_dedup
from arcwave.llm.token_alignment import op12_token_alignment
from arcwave.llm.token_counts import op5_token_counts
from arcwave.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.SQL,
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
