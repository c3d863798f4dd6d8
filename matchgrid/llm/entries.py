"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from matchgrid.llm import bpe, chat_format, conversation_repair, decontamination, fill_in_middle, language_id, line_dedup, near_dedup, pii, quality_rules, sentence_pieces, url_filters, warc


def queries():
    return {
        "op1_language_id": language_id.query,
        "op2_decontamination": decontamination.query,
        "op3_warc": warc.query,
        "op4_pii": pii.query,
        "op5_near_dedup": near_dedup.query,
        "op6_quality_rules": quality_rules.query,
        "op7_url_filters": url_filters.query,
        "op8_chat_format": chat_format.query,
        "op9_bpe": bpe.query,
        "op10_line_dedup": line_dedup.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_fill_in_middle": fill_in_middle.query,
        "op13_sentence_pieces": sentence_pieces.query,
    }


def oracle_sql():
    return {
        "op3_warc": warc.ORACLE,
        "op5_near_dedup": near_dedup.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op7_url_filters": url_filters.ORACLE,
        "op8_chat_format": chat_format.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op12_fill_in_middle": fill_in_middle.ORACLE,
    }
