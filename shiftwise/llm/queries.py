"""The operators as queries over the given tables, and the SQL they are checked against."""

from __future__ import annotations

from shiftwise.llm.ann import op4_neighbours
from shiftwise.llm.bpe import op8_bpe
from shiftwise.llm.chat import OP1_SQL, op1_chat
from shiftwise.llm.decontaminate import OP13_SQL, op13_decontaminate
from shiftwise.llm.jaccard import op6_jaccard
from shiftwise.llm.langid import op5_language
from shiftwise.llm.lm import op2_lm
from shiftwise.llm.manifest import OP11_SQL, op11_manifest
from shiftwise.llm.maxscore import OP7_SQL, op7_maxscore
from shiftwise.llm.mixing import OP3_SQL, op3_mix
from shiftwise.llm.pii import op9_pii
from shiftwise.llm.sharding import op10_shards
from shiftwise.llm.spelling import OP12_SQL, op12_spelling

QUERIES = {
    "op1_chat": op1_chat,
    "op2_lm": op2_lm,
    "op3_mix": op3_mix,
    "op4_neighbours": op4_neighbours,
    "op5_language": op5_language,
    "op6_jaccard": op6_jaccard,
    "op7_maxscore": op7_maxscore,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_shards": op10_shards,
    "op11_manifest": op11_manifest,
    "op12_spelling": op12_spelling,
    "op13_decontaminate": op13_decontaminate,
}

SQL = {
    "op1_chat": OP1_SQL, "op3_mix": OP3_SQL, "op7_maxscore": OP7_SQL, "op11_manifest": OP11_SQL, "op12_spelling": OP12_SQL,
    "op13_decontaminate": OP13_SQL,
}
