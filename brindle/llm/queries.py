"""The queries of this subpackage and their DuckDB SQL, for __spark_entry__.py."""

from __future__ import annotations

from brindle.llm import sql
from brindle.llm.chat import op5_chat_formatting
from brindle.llm.decontam import op1_decontamination
from brindle.llm.hard_negatives import op12_hard_negatives
from brindle.llm.html_text import op7_html_extraction
from brindle.llm.language import op4_language_id
from brindle.llm.licences import op3_licence_scan
from brindle.llm.media import op9_media_columns
from brindle.llm.ngram_join import op6_ngram_jaccard
from brindle.llm.output import op10_token_output
from brindle.llm.packing import op2_packing
from brindle.llm.prefix_trie import op13_prefix_trie
from brindle.llm.substring import op8_substring_dedup
from brindle.llm.suffix_dedup import op11_suffix_dedup

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_licence_scan": op3_licence_scan,
    "op4_language_id": op4_language_id,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_token_output": op10_token_output,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op1_decontamination": sql.DECONTAMINATION, "op5_chat_formatting": sql.CHAT, "op6_ngram_jaccard": sql.NGRAM_JACCARD, "op11_suffix_dedup": sql.SUFFIX_DEDUP, "op12_hard_negatives": sql.HARD_NEGATIVES, "op13_prefix_trie": sql.PREFIX_TRIE}
