"""The corpus queries that the entry module registers, and their SQL where SQL can express them."""

from __future__ import annotations

from lineagraph.llm.bpe import op2_bpe
from lineagraph.llm.byte_bpe import op13_byte_bpe
from lineagraph.llm.conversation_trie import OP12_SQL, op12_prefix_trie
from lineagraph.llm.cws import op7_fingerprints
from lineagraph.llm.host_rules import OP5_SQL, op5_host_rules
from lineagraph.llm.line_dedup import OP9_SQL, op9_line_dedup
from lineagraph.llm.ngram_lm import op4_lm
from lineagraph.llm.packing import op10_packing
from lineagraph.llm.ranked_search import OP11_SQL, op11_ranked_search
from lineagraph.llm.sharding import op3_sharding
from lineagraph.llm.simhash import op6_simhash
from lineagraph.llm.substring_dedup import op1_substring_dedup
from lineagraph.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_lm": op4_lm,
    "op5_host_rules": op5_host_rules,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op5_host_rules": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
