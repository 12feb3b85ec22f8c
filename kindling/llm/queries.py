"""Registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from kindling.llm.ann import op6_ann
from kindling.llm.bpe import op10_bpe
from kindling.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from kindling.llm.decision_list import op3_decision_list
from kindling.llm.neardup import op2_neardup
from kindling.llm.packing import op8_packing
from kindling.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from kindling.llm.quality import op9_quality
from kindling.llm.sharding import op4_sharding
from kindling.llm.suffix_tree import op1_suffix_tree
from kindling.llm.token_counts import op5_token_counts
from kindling.llm.toxicity import op7_toxicity
from kindling.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_neardup": op2_neardup,
    "op3_decision_list": op3_decision_list,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_ann": op6_ann,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_warc": OP13_SQL,
}
