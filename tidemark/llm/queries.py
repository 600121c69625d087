"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, decontamination, licences, near_dedup, pii, quality, repeats, token_files, top_k, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op5_token_files": token_files.op5_token_files,
    "op6_repeats": repeats.op6_repeats,
    "op7_licences": licences.op7_licences,
    "op8_top_k": top_k.op8_top_k,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": decontamination.sql(),
    "op7_licences": licences.sql(),
    "op8_top_k": top_k.sql(),
    "op9_url_filter": url_filter.sql(),
    "op10_near_dedup": near_dedup.sql(),
}
