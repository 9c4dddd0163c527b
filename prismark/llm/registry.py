"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from prismark.llm import bpe, chat, packing, pii, rules, secrets, sharding, simhash, toxicity, vectors

QUERIES = {
    "op1_rule_ledger": rules.op1_rule_ledger,
    "op2_p_stable_vectors": vectors.op2_p_stable_vectors,
    "op3_simhash_bit_planes": simhash.op3_simhash_bit_planes,
    "op4_byte_balanced_shards": sharding.op4_byte_balanced_shards,
    "op5_levenshtein_lexicon": toxicity.op5_levenshtein_lexicon,
    "op6_term_disclosure": pii.op6_term_disclosure,
    "op7_guess_cost_secrets": secrets.op7_guess_cost_secrets,
    "op8_vector_bin_packing": packing.op8_vector_bin_packing,
    "op9_prefix_bpe": bpe.op9_prefix_bpe,
    "op10_reply_trees": chat.op10_reply_trees,
    "rule_ablations": rules.rule_ablations,
    "reply_tree_branches": chat.reply_tree_branches,
}

ORACLE_SQL = {
    "op1_rule_ledger": rules.OP1_SQL,
    "op2_p_stable_vectors": vectors.OP2_SQL,
    "op4_byte_balanced_shards": sharding.OP4_SQL,
    "op10_reply_trees": chat.OP10_SQL,
    "rule_ablations": rules.ABLATION_SQL,
    "reply_tree_branches": chat.BRANCHES_SQL,
}
