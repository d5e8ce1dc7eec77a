"""Operators for training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

from larderflow.llm.alignment import op11_alignment
from larderflow.llm.conversation_trie import ORACLE as TRIE_ORACLE
from larderflow.llm.conversation_trie import op12_conversation_trie
from larderflow.llm.imatch import op2_imatch
from larderflow.llm.lsh_forest import op10_lsh_forest
from larderflow.llm.packing import op7_best_fit
from larderflow.llm.piece_bpe import op9_sentencepiece
from larderflow.llm.quality import op13_quality
from larderflow.llm.secrets import op3_secret_scan
from larderflow.llm.substring import op6_substring_dedup
from larderflow.llm.token_shards import op4_token_shards
from larderflow.llm.toxicity import op1_toxicity
from larderflow.llm.url_filter import op5_url_filter
from larderflow.llm.voronoi import ORACLE as TOP_K_ORACLE
from larderflow.llm.voronoi import op8_voronoi_top_k


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_imatch": op2_imatch, "op3_secret_scan": op3_secret_scan, "op4_token_shards": op4_token_shards, "op5_url_filter": op5_url_filter, "op6_substring_dedup": op6_substring_dedup, "op7_best_fit": op7_best_fit, "op8_voronoi_top_k": op8_voronoi_top_k, "op9_sentencepiece": op9_sentencepiece, "op10_lsh_forest": op10_lsh_forest, "op11_alignment": op11_alignment, "op12_conversation_trie": op12_conversation_trie, "op13_quality": op13_quality}


def oracle_sql() -> dict[str, str]:
    """The other queries need tokenizers, hashing or trained models, or are too slow as SQL on whole tables; tests hold them against brute force."""
    return {"op8_voronoi_top_k": TOP_K_ORACLE, "op12_conversation_trie": TRIE_ORACLE}
