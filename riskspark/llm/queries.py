"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from riskspark.llm import blocklstm, capfilter, convrepair, license_template, orc_tokens, qgram, revsearch, sanitise, setsketch, tokencount, transducer, warc, wordlang

QUERIES = {
    "op2_recurrent_blocks": blocklstm.op2_recurrent_blocks,
    "op7_disclosure_pii": sanitise.op7_disclosure_pii,
    "op8_cap_filters": capfilter.op8_cap_filters,
    "op9_word_language": wordlang.op9_word_language,
    "op4_qgram_decontamination": qgram.op4_qgram_decontamination,
    "op3_setsketch_dedup": setsketch.op3_setsketch_dedup,
    "op6_transducer_bpe": transducer.op6_transducer_bpe,
    "op5_orc_tokens": orc_tokens.op5_orc_tokens,
    "op1_warc": warc.op1_warc,
    "op10_license_templates": license_template.op10_license_templates,
    "op11_whole_tokens": tokencount.op11_whole_tokens,
    "op12_path_ranking": convrepair.op12_path_ranking,
    "op13_reversed_search": revsearch.op13_reversed_search,
}

ORACLE_SQL = {
    "op8_cap_filters": capfilter.ORACLE,
    "op3_setsketch_dedup": setsketch.oracle(),
    "op1_warc": warc.ORACLE,
    "op10_license_templates": license_template.oracle(),
    "op12_path_ranking": convrepair.ORACLE,
    "op13_reversed_search": revsearch.ORACLE,
}
