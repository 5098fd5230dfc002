"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from platewise.llm import (
    chat_format,
    decontamination,
    hard_negatives,
    license_scan,
    mixing,
    ngram_join,
    quality_crf,
    quality_rules,
    token_counts,
    token_files,
    toxicity_gru,
    warc,
    whitening,
)

QUERIES = {
    "op1_quality_crf": quality_crf.op1_quality_crf,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity_gru": toxicity_gru.op5_toxicity_gru,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_token_files": token_files.op9_token_files,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
