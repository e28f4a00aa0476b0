"""Queries and oracle SQL of the numbered operators."""

from .bpe import op3_bpe
from .centroids import OP12_SQL, op12_centroids
from .chat_format import OP10_SQL, op10_chat_format
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .license_scan import OP9_SQL, op9_license_scan
from .near_dedup import op4_near_dedup
from .packing import op8_packing
from .quality_model import op6_quality_model
from .quality_rules import op5_quality_rules
from .substring_dedup import op7_substring_dedup
from .toxicity import op1_toxicity
from .vector_dedup import op13_vector_dedup
from .whitening import op11_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_model": op6_quality_model,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_vector_dedup": op13_vector_dedup,
}

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op9_license_scan": OP9_SQL, "op10_chat_format": OP10_SQL, "op12_centroids": OP12_SQL}
