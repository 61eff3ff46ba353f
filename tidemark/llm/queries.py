"""Registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from .alignment import op11_cross_tokenizer
from .byte_bpe import op13_byte_bpe
from .conversations import op12_conversation_repair
from .embedding_dedup import op6_embedding_dedup
from .exact_dedup import ORACLE as EXACT_DEDUP_SQL
from .exact_dedup import op4_exact_dedup
from .html_text import op8_html_text
from .langid import op7_language_id
from .license_scan import op9_license_scan
from .mixing import op3_mix_sources
from .ngram_join import op10_ngram_join
from .oracles import NEAR, REPAIRS, SUBSTRINGS, VECTORS
from .pieces import op5_piece_encode
from .secret_scan import op1_secret_scan
from .substring_dedup import op2_substring_dedup

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_piece_encode": op5_piece_encode,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_language_id": op7_language_id,
    "op8_html_text": op8_html_text,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_join": op10_ngram_join,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {
    "op2_substring_dedup": SUBSTRINGS,
    "op4_exact_dedup": EXACT_DEDUP_SQL,
    "op6_embedding_dedup": VECTORS,
    "op10_ngram_join": NEAR,
    "op12_conversation_repair": REPAIRS,
}
