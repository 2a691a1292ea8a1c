"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from . import exact_dedup, html_extract, importance, license_scan, mixing, packing, quality_rules, secret_scan, sentencepiece_codec, simhash, token_count, token_files, vector_codes

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op2_secret_scan": secret_scan.oracle_sql(),
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
    "op13_vector_codes": vector_codes.oracle_sql(),
}
