"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from . import bpe, collocations, embeddings, jaccard, media, mixing, secret_scan, sharding, substrings, token_shards, toxicity, warc, whitening

QUERIES = {
    "op1_token_shards": token_shards.op1_token_shards,
    "op2_sharding": sharding.op2_sharding,
    "op3_substrings": substrings.op3_substrings,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_media": media.op7_media,
    "op8_warc": warc.op8_warc,
    "op9_near_vectors": embeddings.op9_near_vectors,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_secrets": secret_scan.op11_secrets,
    "op12_collocations": collocations.op12_collocations,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
