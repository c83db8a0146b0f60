"""The queries of the text operators, and their SQL where there is one."""

from __future__ import annotations

from lattica.llm import decontaminate, fill_middle, jaccard, language, line_dedup, minhash, packing, passages, pieces, quality_model, quality_rules, spelling, surrogates

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": language.op2_language_id,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_passages": passages.op4_passages,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_spelling": spelling.op12_spelling,
    "op13_minhash": minhash.op13_minhash,
}

SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_minhash": minhash.OP13_SQL,
}
