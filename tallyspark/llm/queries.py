"""Registered queries of the training-data operators and their DuckDB counterparts."""

from tallyspark.llm import alignment, bpe, language, mixing, neighbours, packing, quality, ranked, repeats, secrets, simhash, tokenfiles, warc

QUERIES = {
    "op1_entropy_balanced_mix": mixing.op1_entropy_balanced_mix,
    "op2_simhash_components": simhash.op2_simhash_components,
    "op3_line_frequency": quality.op3_line_frequency,
    "op4_maxent_scores": language.op4_maxent_scores,
    "op5_ranked_token_files": tokenfiles.op5_ranked_token_files,
    "op6_multiprobe_neighbours": neighbours.op6_multiprobe_neighbours,
    "op7_warc_transactions": warc.op7_warc_transactions,
    "op8_removed_repeats": repeats.op8_removed_repeats,
    "op9_streaming_bpe": bpe.op9_streaming_bpe,
    "op10_linked_secrets": secrets.op10_linked_secrets,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_best_positions": ranked.op12_best_positions,
    "op13_shared_cuts": alignment.op13_shared_cuts,
}

ORACLE_SQL = {
    "op3_line_frequency": quality.ORACLE,
    "op10_linked_secrets": secrets.oracle(),
    "op12_best_positions": ranked.ORACLE,
}
