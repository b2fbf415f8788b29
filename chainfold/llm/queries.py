"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, licenses, line_dedup, mixing, near_dedup, quality, sharding, tokens, url_filters

QUERIES = {f.__name__: f for f in (
    licenses.op1_license_scan,
    decontamination.op2_decontamination,
    line_dedup.op3_line_dedup,
    tokens.op4_token_ids,
    sharding.op5_sharding,
    quality.op7_quality_rules,
    near_dedup.op6_near_dedup,
    chat.op8_chat_formatting,
    mixing.op9_mixing,
    url_filters.op10_url_filters,
)}
#: op4 (tokenizer ids), op5 (CRC-32) and op9 (seeded rounding) are beyond SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op2_decontamination": decontamination.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
