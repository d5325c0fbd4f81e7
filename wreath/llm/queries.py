"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from wreath.llm.chat_snapshots import OP2_SQL, op2_chat_snapshots
from wreath.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from wreath.llm.cross_parse import op7_language
from wreath.llm.deleted_interpolation import op10_lm_score
from wreath.llm.feistel_shards import op4_feistel_shards
from wreath.llm.kneser_ney import op9_toxicity
from wreath.llm.line_dedup import OP11_SQL, op11_line_dedup
from wreath.llm.pairwise_quality import op6_quality
from wreath.llm.poly_fingerprint import OP3_SQL, op3_exact_dedup
from wreath.llm.prob_minhash import op1_near_duplicates
from wreath.llm.raking import op8_mix_sources
from wreath.llm.token_alignment import op13_token_alignment
from wreath.llm.winnowing import op5_decontamination

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_mix_sources": op8_mix_sources,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op2_chat_snapshots": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
