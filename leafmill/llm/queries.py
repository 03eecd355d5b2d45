"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .align import op11_groups
from .fingerprints import OP2_SQL, op2_spotsigs
from .idfiles import op5_id_files
from .langid import op8_langid
from .near import OP6_SQL, op6_lsh_forest
from .packing import op9_packing
from .pieces import op7_sentencepiece
from .pii import op10_pii
from .repeats import OP3_SQL, op3_phrase_automata
from .sharding import OP4_SQL, op4_virtual_slots
from .stamps import OP12_SQL, op12_stamps
from .topk import OP1_SQL, op1_kd_trees
from .toxicity import op13_toxic_spans

QUERIES = {
    "op1_kd_trees": op1_kd_trees,
    "op2_spotsigs": op2_spotsigs,
    "op3_phrase_automata": op3_phrase_automata,
    "op4_virtual_slots": op4_virtual_slots,
    "op5_id_files": op5_id_files,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_groups": op11_groups,
    "op12_stamps": op12_stamps,
    "op13_toxic_spans": op13_toxic_spans,
}
ORACLE: dict[str, str] = {
    "op1_kd_trees": OP1_SQL,
    "op2_spotsigs": OP2_SQL,
    "op3_phrase_automata": OP3_SQL,
    "op4_virtual_slots": OP4_SQL,
    "op6_lsh_forest": OP6_SQL,
    "op12_stamps": OP12_SQL,
}
