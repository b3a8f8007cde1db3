"""The numbered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from leadloom.llm import byte_bpe, jaccard_join, line_dedup, maxscore, ns_kmeans, packing, pii, prefix_trie, quality_rules, resharding, sentencepiece_codec, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_resharding": resharding.op6_resharding,
    "op7_maxscore": maxscore.op7_maxscore,
    "op8_warc": warc.op8_warc,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_ns_kmeans": ns_kmeans.op11_ns_kmeans,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op7_maxscore": maxscore.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_ns_kmeans": ns_kmeans.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
