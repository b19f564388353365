"""The text operators' queries and oracle SQL."""

from __future__ import annotations

from . import op01_sharding as op1
from . import op02_mixing as op2
from . import op03_suffixes as op3
from . import op04_bpe as op4
from . import op05_substrings as op5
from . import op06_secrets as op6
from . import op07_quality as op7
from . import op08_fingerprints as op8
from . import op09_minhash as op9
from . import op10_chat as op10

QUERIES = {
    "op1_rendezvous_sharding": op1.op1_rendezvous_sharding,
    "op2_hypergeometric_mixing": op2.op2_hypergeometric_mixing,
    "op3_suffix_array_dedup": op3.op3_suffix_array_dedup,
    "op4_byte_bpe": op4.op4_byte_bpe,
    "op5_substring_dedup": op5.op5_substring_dedup,
    "op6_secret_scan": op6.op6_secret_scan,
    "op7_quality_rules": op7.op7_quality_rules,
    "op8_quartile_digest": op8.op8_quartile_digest,
    "op9_minhash_near_dedup": op9.op9_minhash_near_dedup,
    "op10_reply_trees": op10.op10_reply_trees,
}

#: Where SQL can express the whole result.
ORACLES = {
    "op3_suffix_array_dedup": op3.ORACLE_SQL,
    "op5_substring_dedup": op5.ORACLE_SQL,
    "op9_minhash_near_dedup": op9.ORACLE_SQL,
    "op10_reply_trees": op10.ORACLE_SQL,
}
