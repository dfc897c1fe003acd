"""The subpackage's registered queries, and the SQL for those that SQL can express."""

from __future__ import annotations

from scriptoria.llm.decontaminate import OP3_SQL, op3_query
from scriptoria.llm.hilbert import op1_query
from scriptoria.llm.lempel_ziv import op2_query
from scriptoria.llm.lines import OP7_SQL, op7_query
from scriptoria.llm.minhash import OP4_SQL, op4_query
from scriptoria.llm.pieces import op10_query
from scriptoria.llm.quality import op6_query
from scriptoria.llm.revisits import OP5_SQL, op5_query
from scriptoria.llm.spans import OP9_SQL, op9_query
from scriptoria.llm.toxicity import op8_query

QUERIES = {
    "op1_hilbert_shards": op1_query,
    "op2_lempel_ziv_fingerprints": op2_query,
    "op3_decontamination": op3_query,
    "op4_minhash_near_dedup": op4_query,
    "op5_revisit_resolution": op5_query,
    "op6_byte_network_quality": op6_query,
    "op7_line_dedup": op7_query,
    "op8_kneser_ney_toxicity": op8_query,
    "op9_repeated_spans": op9_query,
    "op10_prefix_table_pieces": op10_query,
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op9_repeated_spans": OP9_SQL, "op5_revisit_resolution": OP5_SQL, "op7_line_dedup": OP7_SQL}
