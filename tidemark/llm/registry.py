"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, licenses, near_duplicates, neighbours, pieces, quality, ranked, repeats, secrets, sharding, token_codes, tries, warc


def queries() -> dict:
    return {
        "op1_token_codes": token_codes.op1_token_codes,
        "op2_warc": warc.op2_warc,
        "op3_jump_shards": sharding.op3_jump_shards,
        "op6_secrets": secrets.op6_secrets,
        "op4_quality": quality.op4_quality,
        "op5_neighbours": neighbours.op5_neighbours,
        "op7_repeats": repeats.op7_repeats,
        "op8_near_duplicates": near_duplicates.op8_near_duplicates,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_pieces": pieces.op10_pieces,
        "op11_trie": tries.op11_trie,
        "op12_ranked": ranked.op12_ranked,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_jump_shards": sharding.ORACLE_SQL,
        "op5_neighbours": neighbours.ORACLE_SQL,
        "op6_secrets": secrets.ORACLE_SQL,
        "op7_repeats": repeats.ORACLE_SQL,
        "op9_decontaminate": decontaminate.ORACLE_SQL,
        "op11_trie": tries.ORACLE_SQL,
        "op12_ranked": ranked.ORACLE_SQL,
        "op13_licenses": licenses.ORACLE_SQL,
    }
