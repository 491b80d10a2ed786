"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from memlake.llm.alignment import op13_token_alignment
from memlake.llm.bpe import op4_byte_bpe
from memlake.llm.chat import OP6_SQL, op6_chat_format
from memlake.llm.licenses import op2_license_scan
from memlake.llm.line_dedup import op9_line_dedup
from memlake.llm.mixing import OP5_SQL, op5_source_mix
from memlake.llm.negatives import OP12_SQL, op12_hard_negatives
from memlake.llm.ngram_join import OP8_SQL, op8_ngram_join
from memlake.llm.pii import op3_personal_data
from memlake.llm.quality import OP10_SQL, op10_quality_rules
from memlake.llm.search import OP1_SQL, op1_exact_top_k
from memlake.llm.toxicity import op7_toxicity
from memlake.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_license_scan": op2_license_scan,
    "op3_personal_data": op3_personal_data,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_source_mix": op5_source_mix,
    "op6_chat_format": op6_chat_format,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_warc": op11_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op1_exact_top_k": OP1_SQL,
    "op5_source_mix": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_ngram_join": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_warc": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
