"""The corpus queries, one for each operator, and their SQL."""

from terrane.llm import (chat, decontamination, infilling, langid, lattice, ordering, packing, pii, rules, sharding, similarity, substring,
                         vectorcodes)

QUERIES = {f.__name__: f for f in (
    similarity.op1_ngram_jaccard_join,
    substring.op2_super_kmer_dedup,
    chat.op3_chat_loss_masks,
    langid.op4_output_code_language_id,
    ordering.op5_feistel_training_order,
    pii.op6_anchor_pii,
    sharding.op7_balanced_shards,
    rules.op8_quality_rules,
    decontamination.op9_benchmark_decontamination,
    packing.op10_cutting_stock_packing,
    lattice.op11_lattice_likelihood,
    infilling.op12_fill_in_middle,
    vectorcodes.op13_vector_codes,
)}

ORACLES = {
    "op2_super_kmer_dedup": substring.OP2_SQL,
    "op9_benchmark_decontamination": decontamination.OP9_SQL,
    "op12_fill_in_middle": infilling.OP12_SQL,
    "op13_vector_codes": vectorcodes.OP13_SQL,
}
