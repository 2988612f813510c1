"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm import cover_dedup, fill_middle, fm_index, mixing, noisy_channel, periodic_runs, piece_table, quality_rules, simhash, subwords, suffix_dedup, token_files, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontaminate": fm_index.op3_decontaminate,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_quality_classifier": subwords.op5_quality_classifier,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_files": token_files.op7_token_files,
    "op8_cover_dedup": cover_dedup.op8_cover_dedup,
    "op10_toxicity": noisy_channel.op10_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_sentencepiece": piece_table.op13_sentencepiece,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_decontaminate": fm_index.OP3_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op8_cover_dedup": cover_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
}
