"""The dealt operators' queries and their SQL."""

from __future__ import annotations

from weftline.llm import chat, decontam, licenses, lm_score, packing, quality, secret_scan, sharding, simhash, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_shard": sharding.op2_shard,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_packing": packing.op4_packing,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_chat_format": chat.op6_chat_format,
    "op7_warc": warc.op7_warc,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_decontaminate": decontam.op10_decontaminate,
}
ORACLES = {
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_decontaminate": decontam.OP10_SQL,
}
