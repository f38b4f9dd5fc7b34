"""Queries of the training-data operators and, where SQL can say it, their twins."""

from __future__ import annotations

from tidelog.llm import chat, langid, mixing, packing, quality_rules, simhash, token_store, topk, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_mixing": mixing.query,
    "op3_simhash": simhash.query,
    "op4_chat_format": chat.query,
    "op5_token_store": token_store.query,
    "op6_warc_fixity": warc.query,
    "op7_language_id": langid.query,
    "op8_topk_search": topk.query,
    "op9_packing": packing.query,
    "op10_toxicity": toxicity.query,
}

ORACLE: dict[str, str] = {
    "op4_chat_format": chat.SQL,
    "op6_warc_fixity": warc.SQL,
    "op8_topk_search": topk.SQL,
}
