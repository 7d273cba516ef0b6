"""The registered queries of this subpackage, each over its whole table with production parameters."""

from kithgraph.llm import clusters, harmonic, importance, lm, merkle, mixing, packing, quality, revisits, secret_scan, simhash, sstable, topk

QUERIES = {
    "op1_kd_topk": topk.query,
    "op2_mix_sources": mixing.query,
    "op3_gated_lm_scores": lm.query,
    "op4_sstable_tokens": sstable.query,
    "op5_pack_sequences": packing.query,
    "op6_warc_revisits": revisits.query,
    "op7_merkle_fingerprints": merkle.query,
    "op8_secret_spans": secret_scan.query,
    "op9_simhash_groups": simhash.query,
    "op10_quality_scores": quality.query,
    "op11_block_norm_clusters": clusters.query,
    "op12_harmonic_packing": harmonic.query,
    "op13_importance_resampling": importance.query,
}
ORACLE_SQL = {
    "op1_kd_topk": topk.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op6_warc_revisits": revisits.ORACLE,
    "op7_merkle_fingerprints": merkle.ORACLE,
    "op11_block_norm_clusters": clusters.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
