"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

from driftlens.llm.decontamination import op3_decontamination
from driftlens.llm.filter_audit import OP12_SQL, op12_filter_audit
from driftlens.llm.importance import OP11_SQL, op11_importance
from driftlens.llm.licenses import PHRASES_SQL, licence_phrases, op10_licenses
from driftlens.llm.line_dedup import OP9_SQL, op9_line_dedup
from driftlens.llm.mixing import SOURCE_TOTALS_SQL, op6_mixing, source_totals
from driftlens.llm.quality import op7_quality
from driftlens.llm.simhash import op1_simhash
from driftlens.llm.suffix_dedup import op4_suffix_array
from driftlens.llm.token_counts import TOTALS_SQL, op5_token_counts, word_and_byte_totals
from driftlens.llm.toxicity import op8_toxicity
from driftlens.llm.transport_stream import STORED_SQL, op2_transport_stream, stored_texts
from driftlens.llm.url_filter import RULES_SQL, op13_url_filter, url_rules

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_transport_stream": op2_transport_stream,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_array": op4_suffix_array,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_licenses": op10_licenses,
    "op11_importance": op11_importance,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filter": op13_url_filter,
    # what SQL can say of the operators above, over the same whole tables
    "stored_texts": stored_texts,
    "word_and_byte_totals": word_and_byte_totals,
    "source_totals": source_totals,
    "licence_phrases": licence_phrases,
    "url_rules": url_rules,
}

SQL: dict[str, str] = {
    "op9_line_dedup": OP9_SQL,
    "op11_importance": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "stored_texts": STORED_SQL,
    "word_and_byte_totals": TOTALS_SQL,
    "source_totals": SOURCE_TOTALS_SQL,
    "licence_phrases": PHRASES_SQL,
    "url_rules": RULES_SQL,
}
