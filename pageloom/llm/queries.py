"""The queries of this package, and their SQL twins where SQL can say them."""

from __future__ import annotations

from pageloom.llm.alignment import op12_tokenizer_alignment
from pageloom.llm.archives import op4_warc
from pageloom.llm.chat import OP6_SQL, op6_chat_format
from pageloom.llm.decontaminate import OP1_SQL, op1_benchmark_decontamination
from pageloom.llm.lines import OP2_SQL, op2_line_dedup
from pageloom.llm.packing import op10_lexical_packing
from pageloom.llm.piecewise import op13_piecewise_fingerprints
from pageloom.llm.simhash import op5_simhash
from pageloom.llm.substring import OP3_SQL, op3_substring_dedup
from pageloom.llm.surrogates import op9_pii_surrogates
from pageloom.llm.toxicity import op7_toxicity
from pageloom.llm.turns import OP11_SQL, op11_conversation_repair
from pageloom.llm.vectors import OP8_SQL, op8_embedding_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_line_dedup, op3_substring_dedup, op4_warc, op5_simhash, op6_chat_format,
        op7_toxicity, op8_embedding_dedup, op9_pii_surrogates, op10_lexical_packing,
        op11_conversation_repair, op12_tokenizer_alignment, op13_piecewise_fingerprints,
    )
}
ORACLE = {
    "op1_benchmark_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL,
    "op6_chat_format": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL,
}
