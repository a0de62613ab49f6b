"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from taproom.llm import (
    chat_format,
    collocations,
    decontaminate,
    exact_dedup,
    extract_html,
    fill_middle,
    langid,
    lbl_scoring,
    minhash,
    packing,
    simhash,
    toxicity,
    warc,
)

QUERIES = {
    "op1_toxicity_grades": toxicity.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_warc_converter": warc.op3,
    "op4_language_id": langid.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_lbl_scoring": lbl_scoring.op7,
    "op8_preference_format": chat_format.op8,
    "op9_html_main_text": extract_html.op9,
    "op10_benchmark_decontamination": decontaminate.op10,
    "op11_phrase_collocations": collocations.op11,
    "op12_minhash_near_dedup": minhash.op12,
    "op13_fill_in_middle": fill_middle.op13,
}
SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op8_preference_format": chat_format.SQL,
    "op11_phrase_collocations": collocations.SQL,
    "op12_minhash_near_dedup": minhash.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
