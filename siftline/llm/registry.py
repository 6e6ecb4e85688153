"""The registered queries of this part and their oracle SQL."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .embedding import OP9_SQL, op9_embedding
from .language import op4_language
from .mixing import op2_mixing
from .paragraphs import OP6_SQL, op6_paragraphs
from .pii import op3_pii
from .shard import op8_shard
from .simhash import op10_simhash
from .token_store import op7_token_store
from .toxicity import op5_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_paragraphs": op6_paragraphs,
    "op7_token_store": op7_token_store,
    "op8_shard": op8_shard,
    "op9_embedding": op9_embedding,
    "op10_simhash": op10_simhash,
}
#: What SQL can express; tests hold the other operators against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op6_paragraphs": OP6_SQL, "op9_embedding": OP9_SQL}
