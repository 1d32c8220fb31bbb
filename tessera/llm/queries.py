"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.decontaminate import op1_decontamination
from tessera.llm.language_id import op10_language_id
from tessera.llm.mixing import op7_mixing
from tessera.llm.nearest import op3_nearest
from tessera.llm.ngram_join import op8_ngram_join
from tessera.llm.quality import op9_quality
from tessera.llm.token_files import op2_token_files
from tessera.llm.toxicity import op4_toxicity
from tessera.llm.url_filters import OP5_SQL, op5_url_filters
from tessera.llm.warc import op6_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}
SQL: dict[str, str] = {"op5_url_filters": OP5_SQL}
