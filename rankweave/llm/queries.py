"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import decontam, divergence, langid, licences, ngram_join, packing, quality, ranking, secret_scan, sharding, spelling, substring, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_language_id": langid.op2_language_id,
        "op3_suffix_automata": substring.op3_suffix_automata,
        "op4_hypergeometric_shards": sharding.op4_hypergeometric_shards,
        "op5_signature_tree_join": ngram_join.op5_signature_tree_join,
        "op6_secret_ownership": secret_scan.op6_secret_ownership,
        "op7_warc": warc.op7_warc,
        "op8_licence_rules": licences.op8_licence_rules,
        "op9_fm_index": decontam.op9_fm_index,
        "op10_compression_bands": quality.op10_compression_bands,
        "op11_errata_trie": spelling.op11_errata_trie,
        "op12_bradley_terry": ranking.op12_bradley_terry,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_automata": substring.OP3_SQL,
        "op5_signature_tree_join": ngram_join.OP5_SQL,
        "op6_secret_ownership": secret_scan.OP6_SQL,
        "op7_warc": warc.OP7_SQL,
        "op8_licence_rules": licences.OP8_SQL,
        "op9_fm_index": decontam.OP9_SQL,
        "op11_errata_trie": spelling.OP11_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
