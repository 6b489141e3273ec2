"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from tidewright.llm import op1_fixity, op10_line_dedup, op11_clustering, op12_pieces, op13_periodic_runs, op2_jaccard_join, op3_quality, op4_mixing, op5_lm_scoring, op6_substring_dedup, op7_sharding, op8_decontamination, op9_embedding_dedup

QUERIES = {
    "op1_fixity": op1_fixity.query,
    "op2_jaccard_join": op2_jaccard_join.query,
    "op3_quality": op3_quality.query,
    "op4_mixing": op4_mixing.query,
    "op5_lm_scoring": op5_lm_scoring.query,
    "op6_substring_dedup": op6_substring_dedup.query,
    "op7_sharding": op7_sharding.query,
    "op8_decontamination": op8_decontamination.query,
    "op9_embedding_dedup": op9_embedding_dedup.query,
    "op10_line_dedup": op10_line_dedup.query,
    "op11_clustering": op11_clustering.query,
    "op12_pieces": op12_pieces.query,
    "op13_periodic_runs": op13_periodic_runs.query,
}

ORACLE_SQL = {
    "op1_fixity": op1_fixity.SQL,
    "op7_sharding": op7_sharding.SQL,
    "op11_clustering": op11_clustering.SQL,
}
