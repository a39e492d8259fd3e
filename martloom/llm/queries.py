"""The registered queries of this package and the SQL of those that SQL can express."""

from martloom.llm import (
    bpe, chat, classifier, decontamination, fertility, interpolation, line_dedup, mixing, neighbours, resampling, sharding, simhash, trie,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_interpolation": interpolation.op2_interpolation,
    "op3_chat": chat.op3_chat,
    "op4_fertility": fertility.op4_fertility,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_classifier": classifier.op8_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_trie": trie.op11_trie,
    "op12_resampling": resampling.op12_resampling,
    "op13_decontamination": decontamination.op13_decontamination,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_chat": chat.OP3_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_trie": trie.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
