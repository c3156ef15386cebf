"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from .ann import op1_ann
from .codebooks import OP13_SQL, op13_codebooks
from .decontam import op7_decontam
from .merkle import OP12_SQL, op12_merkle
from .minhash import OP11_SQL, op11_minhash
from .packing import op6_packing
from .pii import op9_pii
from .secrets import OP3_SQL, op3_secrets
from .sharding import op8_sharding
from .simhash import op10_simhash
from .suffix import op2_suffix
from .toxicity import op4_toxicity
from .urls import op5_urls

QUERIES = {
    "op1_ann": op1_ann,
    "op2_suffix": op2_suffix,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_urls": op5_urls,
    "op6_packing": op6_packing,
    "op7_decontam": op7_decontam,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_minhash": op11_minhash,
    "op12_merkle": op12_merkle,
    "op13_codebooks": op13_codebooks,
}

ORACLES: dict[str, str] = {"op3_secrets": OP3_SQL, "op11_minhash": OP11_SQL, "op12_merkle": OP12_SQL, "op13_codebooks": OP13_SQL}
