"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from modelkeep.llm.op1_toxicity import op1_toxicity
from modelkeep.llm.op2_topk import OP2_SQL, op2_topk
from modelkeep.llm.op3_simhash import op3_simhash
from modelkeep.llm.op4_pii import op4_pii
from modelkeep.llm.op5_decontaminate import OP5_SQL, op5_decontamination
from modelkeep.llm.op6_urls import op6_urls
from modelkeep.llm.op7_bpe import op7_bpe
from modelkeep.llm.op8_substrings import OP8_SQL, op8_substrings
from modelkeep.llm.op9_quality import op9_quality
from modelkeep.llm.op10_lm import op10_corpus_lm
from modelkeep.llm.op11_langid import op11_langid
from modelkeep.llm.op12_merkle import OP12_SQL, op12_merkle
from modelkeep.llm.op13_search import OP13_SQL, op13_search

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_urls": op6_urls,
    "op7_bpe": op7_bpe,
    "op8_substrings": op8_substrings,
    "op9_quality": op9_quality,
    "op10_lm": op10_corpus_lm,
    "op11_langid": op11_langid,
    "op12_merkle": op12_merkle,
    "op13_search": op13_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_topk": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op8_substrings": OP8_SQL,
    "op12_merkle": OP12_SQL,
    "op13_search": OP13_SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
