"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from specloom.llm.chat import OP1_SQL, op1_chat_format
from specloom.llm.decontaminate import op8_decontaminate
from specloom.llm.html_text import op2_html_text
from specloom.llm.language_id import op4_language_id
from specloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from specloom.llm.near_dup import op9_near_dup
from specloom.llm.periodic import op13_periodic_runs
from specloom.llm.piece_codec import op5_sentencepiece
from specloom.llm.quality_rules import op11_quality_rules
from specloom.llm.substring_dedup import op7_substring_dedup
from specloom.llm.suffix_dedup import op3_suffix_dedup
from specloom.llm.token_store import op6_token_store
from specloom.llm.vector_dup import op10_vector_dup

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_html_text": op2_html_text,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_store": op6_token_store,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_dup": op9_near_dup,
    "op10_vector_dup": op10_vector_dup,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op12_merkle_manifest": OP12_SQL}
