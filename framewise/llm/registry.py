"""Queries of the training-text operators, and the SQL of those that SQL can express."""

from . import ann, clusters, decontamination, exact_dedup, language_model, line_dedup, mixing, near_dedup, packing, quality, secrets, spelling, url_filter

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_quality_knn": quality.query,
    "op4_secret_scan": secrets.query,
    "op5_url_temporal_filter": url_filter.query,
    "op6_best_fit_packing": packing.query,
    "op7_soft_mixing": mixing.query,
    "op8_hash_prefix_forest": ann.query,
    "op9_language_model": language_model.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_winnowing": decontamination.query,
    "op12_spelling_variants": spelling.query,
    "op13_yinyang": clusters.query,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op4_secret_scan": secrets.SQL,
    "op5_url_temporal_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_winnowing": decontamination.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_yinyang": clusters.SQL,
}
