"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tesselar.llm import bpe, decontaminate, langid, licenses, linkgraph, quality, repair, secrets, sharding, simhash

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality": quality.op2_quality,
    "op3_shards": sharding.op3_shards,
    "op4_url_filter": linkgraph.op4_url_filter,
    "op5_token_files": repair.op5_token_files,
    "op6_language": langid.op6_language,
    "op7_licenses": licenses.op7_licenses,
    "op8_simhash": simhash.op8_simhash,
    "op9_secrets": secrets.op9_secrets,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op2_quality": quality.OP2_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op9_secrets": secrets.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
