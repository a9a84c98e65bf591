"""The queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from inkveil.llm.bpe import op5_byte_bpe
from inkveil.llm.html import op1_html_extraction
from inkveil.llm.langid import op2_language_id
from inkveil.llm.licenses import OP3_SQL, op3_license_scan
from inkveil.llm.merkle import OP11_SQL, op11_merkle_manifest
from inkveil.llm.packing import op7_packing
from inkveil.llm.prefixes import op12_token_counts
from inkveil.llm.secrets import op10_secret_scan
from inkveil.llm.simhash import op4_simhash_dedup
from inkveil.llm.substrings import op6_suffix_array_dedup
from inkveil.llm.topk import OP8_SQL, op8_exact_topk
from inkveil.llm.turns import op13_conversation_repair
from inkveil.llm.vectors import OP9_SQL, op9_embedding_dedup

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_packing": op7_packing,
    "op8_exact_topk": op8_exact_topk,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op3_license_scan": OP3_SQL,
    "op8_exact_topk": OP8_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
