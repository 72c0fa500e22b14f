"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from sparkcurate.llm import alignment, bpe, decontam, licences, mixing, quality, rules, sharding, simhash, suffixes, trie, urls, vectors

QUERIES = {
    "op1_mix_temperature": mixing.query,
    "op2_license_tfidf": licences.query,
    "op3_shard_feistel": sharding.query,
    "op4_simhash_bytes": simhash.query,
    "op5_rule_ledger": rules.query,
    "op6_vector_pivots": vectors.query,
    "op7_quality_cotraining": quality.query,
    "op8_suffix_doubling": suffixes.query,
    "op9_url_reputation": urls.query,
    "op10_bpe_words": bpe.query,
    "op11_turn_trie": trie.query,
    "op12_exact_alignment": alignment.query,
    "op13_test_suffixes": decontam.query,
}
ORACLES = {
    "op5_rule_ledger": rules.SQL,
    "op6_vector_pivots": vectors.SQL,
    "op9_url_reputation": urls.SQL,
    "op11_turn_trie": trie.SQL,
    "op13_test_suffixes": decontam.SQL,
}
