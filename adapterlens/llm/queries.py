"""Queries over the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from adapterlens.llm.alignment import op11_tokenizer_alignment
from adapterlens.llm.byte_bpe import op13_byte_bpe
from adapterlens.llm.chat import OP6_SQL, op6_chat_rotation
from adapterlens.llm.decontaminate import op9_decontamination
from adapterlens.llm.html_extract import op3_html_extraction
from adapterlens.llm.merkle import op12_merkle_manifest, op12_sql
from adapterlens.llm.pii import op10_pii_crf
from adapterlens.llm.quality import op7_quality_rules
from adapterlens.llm.sentencepiece_scan import op8_sentencepiece
from adapterlens.llm.sharding import op5_sharding
from adapterlens.llm.simhash import op1_simhash_dedup
from adapterlens.llm.substring_dedup import op2_substring_dedup
from adapterlens.llm.url_filter import op4_sql, op4_url_filter

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_pii_crf": op10_pii_crf,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {"op4_url_filter": op4_sql(), "op6_chat_rotation": OP6_SQL, "op12_merkle_manifest": op12_sql()}
