"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from kestrel.llm.chat_format import ORACLE_SQL as CHAT_SQL
from kestrel.llm.chat_format import op9_chat_format
from kestrel.llm.divergence_audit import ORACLE_SQL as DIVERGENCE_SQL
from kestrel.llm.divergence_audit import op12_divergence_audit
from kestrel.llm.hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from kestrel.llm.hard_negatives import op13_hard_negatives
from kestrel.llm.latent_decontamination import op1_latent_decontamination
from kestrel.llm.linear_packing import op6_linear_packing
from kestrel.llm.minhash_dups import op3_minhash_dups
from kestrel.llm.ordinal_quality import op7_ordinal_quality
from kestrel.llm.quality_outliers import op2_quality_outliers
from kestrel.llm.rank_queue_bpe import op11_bitmap_bpe
from kestrel.llm.secrets import op5_secret_scan
from kestrel.llm.sketch_substrings import ORACLE_SQL as SUBSTRINGS_SQL
from kestrel.llm.sketch_substrings import op4_sketch_substrings
from kestrel.llm.suffix_tree_lm import op8_suffix_tree_lm
from kestrel.llm.token_counts import op10_token_counts

QUERIES = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_quality_outliers": op2_quality_outliers,
    "op3_minhash_dups": op3_minhash_dups,
    "op4_sketch_substrings": op4_sketch_substrings,
    "op5_secret_scan": op5_secret_scan,
    "op6_linear_packing": op6_linear_packing,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_suffix_tree_lm": op8_suffix_tree_lm,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_bitmap_bpe": op11_bitmap_bpe,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL where SQL expresses the whole query.
ORACLES: dict[str, str] = {
    "op4_sketch_substrings": SUBSTRINGS_SQL,
    "op9_chat_format": CHAT_SQL,
    "op12_divergence_audit": DIVERGENCE_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
