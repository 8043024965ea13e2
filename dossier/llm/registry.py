"""Queries and SQL of the training-data operators, as __spark_entry__ registers them."""

from dossier.llm import chat, decontaminate, embeddings, exact, infill, langid, lines, minhash, mixing, repeats, spelling, tokens, urls

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_language_id,
        tokens.op2_orc_tokens,
        decontaminate.op3_spaced_seed_leaks,
        minhash.op4_minmax_near_dedup,
        embeddings.op5_cross_polytope,
        lines.op6_patience_lines,
        chat.op7_chat_format,
        urls.op8_url_rules,
        repeats.op9_bwt_repeats,
        mixing.op10_systematic_mix,
        exact.op11_exact_dedup,
        spelling.op12_spelling_variants,
        infill.op13_fill_in_middle,
    )
}

ORACLES = {
    "op3_spaced_seed_leaks": decontaminate.ORACLE_SQL,
    "op4_minmax_near_dedup": minhash.ORACLE_SQL,
    "op5_cross_polytope": embeddings.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op8_url_rules": urls.ORACLE_SQL,
    "op9_bwt_repeats": repeats.ORACLE_SQL,
    "op10_systematic_mix": mixing.ORACLE_SQL,
    "op11_exact_dedup": exact.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_fill_in_middle": infill.ORACLE_SQL,
}
