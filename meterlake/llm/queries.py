"""The subpackage's queries, and SQL for those that SQL can express."""

from meterlake.llm import bpe, embeddings, fingerprints, infill, lattice, lexical, mixing, neighbours, ngram_join, quality, sharding, substrings, warc

QUERIES = {
    "op1_chunk_fingerprints": fingerprints.op1_chunk_fingerprints,
    "op2_co_training": quality.op2_co_training,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_combination_prefixes": ngram_join.op5_combination_prefixes,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_subword_lattice": lattice.op8_subword_lattice,
    "op9_line_hashing": substrings.op9_line_hashing,
    "op10_rotation_codes": embeddings.op10_rotation_codes,
    "op11_maxscore": lexical.op11_maxscore,
    "op12_adaptive_scan": neighbours.op12_adaptive_scan,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op4_warc_salvage": warc.ORACLE_OP4,
    "op5_combination_prefixes": ngram_join.ORACLE_OP5,
    "op6_mix_sources": mixing.ORACLE_OP6,
    "op11_maxscore": lexical.ORACLE_OP11,
    "op13_fill_in_middle": infill.ORACLE_OP13,
}
