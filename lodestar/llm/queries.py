"""The queries of this subpackage and, where SQL can express one, its SQL.

A query opN_base holds the base columns of operator N's rows, which come through the operator, so that they have SQL too.
"""

from __future__ import annotations

from lodestar.llm import filter_audit, html_text, licenses, mixing, oracles, packing, pii, prefix_trie, quality, secret_scan, simhash, subdedup, toxicity, vectors

QUERIES = {
    "op1_length_buckets": packing.op1_length_buckets,
    "op2_html_text": html_text.op2_html_text,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_pii": pii.op5_pii,
    "op6_embedding_near_dedup": vectors.op6_embedding_near_dedup,
    "op7_substring_dedup": subdedup.op7_substring_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "op3_base": lambda spark, sf_dir: licenses.op3_license_scan(spark, sf_dir).drop("labels", "score", "detections"),
    "op4_base": lambda spark, sf_dir: quality.op4_quality_rules(spark, sf_dir).drop("probability", "kept"),
    "op5_base": lambda spark, sf_dir: pii.op5_pii(spark, sf_dir).drop("spans", "n_terms", "sanitised_sha256"),
    "op10_base": lambda spark, sf_dir: secret_scan.op10_secrets(spark, sf_dir).drop("spans", "n_random"),
}

ORACLE_SQL = {
    "op6_embedding_near_dedup": oracles.OP6,
    "op7_substring_dedup": oracles.OP7,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_filter_audit": filter_audit.SQL,
    "op3_base": oracles.OP3_BASE,
    "op4_base": oracles.OP4_BASE,
    "op5_base": oracles.OP5_BASE,
    "op10_base": oracles.OP10_BASE,
}
