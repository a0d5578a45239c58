"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .counting import op7_token_counts
from .decontaminate import op5_decontaminate
from .language import op2_language_id
from .packing import op10_bm25_packing
from .quality import OP8_SQL, op8_quality_rules
from .sharding import op9_virtual_slots
from .simhash import op1_simhash
from .suffix import OP6_SQL, op6_suffix_dedup
from .toxicity import op3_toxicity_chain
from .warc import OP4_SQL, op4_warc_revisits


def queries() -> dict:
    return {"op1_simhash": op1_simhash, "op2_language_id": op2_language_id, "op3_toxicity_chain": op3_toxicity_chain, "op4_warc_revisits": op4_warc_revisits, "op5_decontaminate": op5_decontaminate, "op6_suffix_dedup": op6_suffix_dedup, "op7_token_counts": op7_token_counts, "op8_quality_rules": op8_quality_rules, "op9_virtual_slots": op9_virtual_slots, "op10_bm25_packing": op10_bm25_packing}


def oracle_sql() -> dict:
    return {"op4_warc_revisits": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL}
