"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op5_ann
from .decontam import op8_decontam
from .fixity import OP9_SQL, op9_fixity
from .langid import op6_langid
from .mixing import OP2_SQL, op2_mixing
from .sharding import OP1_SQL, op1_sharding
from .simhash import op10_simhash
from .substring import op3_substring
from .toxicity import op7_toxicity
from .urlfilter import OP4_SQL, op4_urlfilter

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_urlfilter": op4_urlfilter,
    "op5_ann": op5_ann,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_decontam": op8_decontam,
    "op9_fixity": op9_fixity,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op1_sharding": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_urlfilter": OP4_SQL,
    "op9_fixity": OP9_SQL,
}
