"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tradewake.llm.chat import op8_token_level_chat
from tradewake.llm.collocations import op11_stripe_collocations
from tradewake.llm.cotraining import op2_cotrained_quality
from tradewake.llm.decontamination import op9_template_decontamination
from tradewake.llm.language_id import op6_language_mixtures
from tradewake.llm.license_scan import op4_license_bands
from tradewake.llm.near_dedup import op3_minhash_odd_sketches
from tradewake.llm.oracles import ORACLES
from tradewake.llm.packing import op5_minimum_bin_slack
from tradewake.llm.prefix_trie import op12_conversation_trie
from tradewake.llm.quality_rules import op7_robust_outliers
from tradewake.llm.sharding import op1_rendezvous_shards
from tradewake.llm.substrings import op10_debruijn_substrings
from tradewake.llm.token_counts import op13_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_cotrained_quality,
        op3_minhash_odd_sketches,
        op4_license_bands,
        op5_minimum_bin_slack,
        op6_language_mixtures,
        op7_robust_outliers,
        op8_token_level_chat,
        op9_template_decontamination,
        op10_debruijn_substrings,
        op11_stripe_collocations,
        op12_conversation_trie,
        op13_token_counts,
    )
}

__all__ = ["ORACLES", "QUERIES"]
