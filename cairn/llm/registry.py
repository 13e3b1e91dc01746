"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontam import OP5_SQL, op5_decontamination
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_main import op7_html_main
from .langid import op4_language_id
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op1_near_dedup
from .pivot_search import OP12_SQL, op12_pivot_search
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op6_quality
from .sharding import op8_sharding
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_html_main": op7_html_main,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_pivot_search": op12_pivot_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_mixing": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_pivot_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
