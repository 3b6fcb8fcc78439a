"""The queries of this subpackage, and their SQL where it exists."""

from millrace.llm import bpe, exact_dedup, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_count, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_extendible_sharding": sharding.op4_extendible_sharding,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "shards_of_256k": sharding.shards_of_256k,
    "shard_directory": sharding.shard_directory,
}
SQL = {"op2_exact_dedup": exact_dedup.SQL, "op4_extendible_sharding": sharding.SQL, "shards_of_256k": sharding.SQL_SMALL, "shard_directory": sharding.SQL_DIRECTORY}
