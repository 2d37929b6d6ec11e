"""Registered queries of the training-data operators and the SQL of those that SQL expresses."""

from ticketloom.llm import (
    chat, decontamination, language, lexical, line_dedup, maxscore, mixing, periodic, quality, sharding, simhash, substring_dedup,
    warc,
)

QUERIES = {
    "op1_maxscore": maxscore.op1_maxscore,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_language_id": language.op3_language_id,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_chat_format": chat.op8_chat_format,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op1_maxscore": maxscore.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op13_warc": warc.OP13_SQL,
}
