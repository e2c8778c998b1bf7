"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, near_dedup, neighbours, packing, pieces, quality, secrets, sharding, substring_dedup, urls

QUERIES = {
    "op1_order_minhash": near_dedup.op1_order_minhash,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_dimension_scan": neighbours.op3_dimension_scan,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_url_filter": urls.op7_url_filter,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
