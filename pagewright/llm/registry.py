"""The corpus operators' queries and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pagewright.llm import oracles
from pagewright.llm.anisotropic import op4_anisotropic_search
from pagewright.llm.filter_audit import op12_filter_audit
from pagewright.llm.mixing import op5_pivotal_mix
from pagewright.llm.ngram_join import op1_ngram_join
from pagewright.llm.packing import op9_best_fit
from pagewright.llm.private_data import op11_private_data
from pagewright.llm.quality_classifier import op8_random_indexing
from pagewright.llm.quality_rules import op3_line_frequency
from pagewright.llm.reply_trees import op10_reply_trees
from pagewright.llm.secret_scan import op7_secret_spans
from pagewright.llm.suffix_tree import op6_suffix_tree
from pagewright.llm.token_blocks import op2_token_blocks
from pagewright.llm.wand_search import op13_wand_search

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_blocks": op2_token_blocks,
    "op3_line_frequency": op3_line_frequency,
    "op4_anisotropic_search": op4_anisotropic_search,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_secret_spans": op7_secret_spans,
    "op8_random_indexing": op8_random_indexing,
    "op9_best_fit": op9_best_fit,
    "op10_reply_trees": op10_reply_trees,
    "op11_private_data": op11_private_data,
    "op12_filter_audit": op12_filter_audit,
    "op13_wand_search": op13_wand_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_frequency": oracles.LINE_FREQUENCY,
    "op10_reply_trees": oracles.REPLY_TREES,
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_wand_search": oracles.WAND_SEARCH,
}
