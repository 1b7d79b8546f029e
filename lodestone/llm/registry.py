"""The queries of this package and of the corpus pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import licenses
from lodestone.llm.ann import op6_ann
from lodestone.llm.bpe import op3_bpe
from lodestone.llm.decontaminate import op10_decontaminate
from lodestone.llm.langid import op4_langid
from lodestone.llm.licenses import op7_license_scan
from lodestone.llm.neardup import op2_near_dedup
from lodestone.llm.pii import op9_pii
from lodestone.llm.substrings import op1_substring_dedup
from lodestone.llm.toxicity import op8_toxicity
from lodestone.llm.urls import op5_url_filter


def queries() -> dict:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_near_dedup": op2_near_dedup, "op3_bpe": op3_bpe, "op4_langid": op4_langid, "op5_url_filter": op5_url_filter, "op6_ann": op6_ann, "op7_license_scan": op7_license_scan, "op8_toxicity": op8_toxicity, "op9_pii": op9_pii, "op10_decontaminate": op10_decontaminate, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op7_license_scan": licenses.ORACLE_SQL}
