"""The queries of this subpackage and, where SQL can express them, their oracles."""

from hornfels.llm import edit_prints, media, mixing, packing, prefix_trie, quality_classifier, quality_rules, secrets, sharding, simhash, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_media_columns": media.op3_media_columns,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_prefix_trie": prefix_trie.op11_conversation_prefix_trie,
    "op12_vector_code_compression": vector_codes.op12_vector_code_compression,
    "op13_document_fingerprints": edit_prints.op13_document_fingerprints,
}
ORACLES = {"op9_quality_rules": quality_rules.ORACLE, "op11_conversation_prefix_trie": prefix_trie.ORACLE, "op12_vector_code_compression": vector_codes.ORACLE}
