"""Queries of these operators and their SQL twins."""

from __future__ import annotations

from .backoff import OP8_SQL, op8
from .chunk_reuse import op2
from .matroska import op5
from .minhash import op3
from .mtree import OP6_SQL, op6
from .oracles import OP3_SQL, op1_sql, op12_sql
from .packing import op9
from .quality import op4
from .runs import op11
from .secrets import op7
from .sharding import op1
from .url_filter import op12
from .wavelet import op10

QUERIES = {
    "op1_hash_tree_sharding": op1,
    "op2_bpe_chunk_reuse": op2,
    "op3_minhash_near_dedup": op3,
    "op4_attention_quality": op4,
    "op5_matroska": op5,
    "op6_mtree_topk": op6,
    "op7_credential_linking": op7,
    "op8_stupid_backoff": op8,
    "op9_grouping_genetic_packing": op9,
    "op10_wavelet_matrix": op10,
    "op11_periodic_runs": op11,
    "op12_url_ngram_filter": op12,
}

ORACLES: dict[str, str] = {
    "op1_hash_tree_sharding": op1_sql(),
    "op3_minhash_near_dedup": OP3_SQL,
    "op6_mtree_topk": OP6_SQL,
    "op8_stupid_backoff": OP8_SQL,
    "op11_periodic_runs": op11,
    "op12_url_ngram_filter": op12_sql(),
}
