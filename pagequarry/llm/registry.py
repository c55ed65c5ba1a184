"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, classifier, jaccard_join, mixing, order_minhash, quality_rules, sharding, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_byte_bpe": bpe.query,
    "op3_warc": warc.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_sharding": sharding.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_classifier": classifier.query,
    "op9_order_minhash": order_minhash.query,
    "op10_mixing": mixing.query,
}
ORACLES = {
    "op1_quality_rules": quality_rules.oracle(),
    "op10_mixing": mixing.ORACLE,
}
