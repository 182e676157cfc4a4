"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import jaccard, neardup, packing, pieces, pii, quality, quotes, rollups, warc, wavelet


def queries() -> dict:
    own = (
        quotes.op1_quote_threads,
        pii.op2_pii_boosting,
        warc.op3_warc_normaliser,
        packing.op4_vector_packing,
        wavelet.op5_wavelet_shards,
        jaccard.op6_jaccard_groups,
        neardup.op7_pruned_graph,
        quality.op8_quality_cascade,
        rollups.op9_token_rollups,
        pieces.op10_suffix_pieces,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quote_threads": quotes.ORACLE,
        "op3_warc_normaliser": warc.ORACLE,
        "op8_quality_cascade": quality.ORACLE,
    }
