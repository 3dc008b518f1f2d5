"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bitslice_topk import OP7_SQL, op7_exact_top_k
from .language_id import op4_language_id
from .license_scan import OP8_SQL, op8_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_scoring import op2_lm_scoring
from .media import op1_avi_media
from .mixing import op5_mix_sources
from .near_dedup import op9_minhash_near_dedup
from .packing import op3_best_fit_packing
from .quality_rules import op6_quality_rules

QUERIES = {
    "op1_avi_media": op1_avi_media,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL = {"op7_exact_top_k": OP7_SQL, "op8_license_scan": OP8_SQL, "op10_line_dedup": OP10_SQL}
