"""The training-data queries and their SQL equivalents."""

from __future__ import annotations

from . import bpe_counts, chat, decontamination, kmeans, merkle, packing, ppm, quality, simhash, substrings, suffix_dedup, url_rules, warc

QUERIES = {
    "op1_ppm": ppm.query,
    "op2_packing": packing.query,
    "op3_simhash": simhash.query,
    "op4_token_counts": bpe_counts.query,
    "op5_warc": warc.query,
    "op6_substring_dedup": substrings.query,
    "op7_chat_formatting": chat.query,
    "op8_url_filters": url_rules.query,
    "op9_decontamination": decontamination.query,
    "op10_quality_rules": quality.query,
    "op11_elkan": kmeans.query,
    "op12_deep_shallow": suffix_dedup.query,
    "op13_merkle": merkle.query,
}

SQL = {
    "op5_warc": warc.ORACLE_SQL,
    "op6_substring_dedup": substrings.ORACLE_SQL,
    "op7_chat_formatting": chat.ORACLE_SQL,
    "op8_url_filters": url_rules.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_elkan": kmeans.ORACLE_SQL,
    "op12_deep_shallow": suffix_dedup.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
