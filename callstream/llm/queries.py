"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from callstream.llm import (
    conversations,
    jaccard,
    language,
    lines,
    minhash,
    mixing,
    packing,
    pii,
    quality,
    sharding,
    sketches,
    spelling,
    warc,
)

QUERIES = {
    "op1_isolation_forest": quality.op1_isolation_forest,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_uniform_shuffle": sharding.op3_uniform_shuffle,
    "op4_scaled_sketch": sketches.op4_scaled_sketch,
    "op5_weak_supervision": pii.op5_weak_supervision,
    "op6_language": language.op6_language,
    "op7_best_fit": packing.op7_best_fit,
    "op8_chosen_path": jaccard.op8_chosen_path,
    "op9_warc": warc.op9_warc,
    "op10_poisson_mix": mixing.op10_poisson_mix,
    "op11_one_permutation": minhash.op11_one_permutation,
    "op12_viterbi": conversations.op12_viterbi,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op2_line_dedup": lines.OP2_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_poisson_mix": mixing.OP10_SQL,
    "op11_one_permutation": minhash.OP11_SQL,
    "op12_viterbi": conversations.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
