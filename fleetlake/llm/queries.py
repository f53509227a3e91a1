"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, embedding_dedup, license_scan, line_dedup, merkle, mixing, neighbours, quality, sharding, simhash, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_neighbours": neighbours.query,
    "op3_line_dedup": line_dedup.query,
    "op4_license_scan": license_scan.query,
    "op5_bpe": bpe.query,
    "op6_sharding": sharding.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_simhash": simhash.query,
    "op9_quality": quality.query,
    "op10_mixing": mixing.query,
    "op11_merkle": merkle.query,
    "op12_decontamination": decontaminate.query,
    "op13_whitening": whitening.query,
}

SQL = {"op3_line_dedup": line_dedup.SQL, "op7_embedding_dedup": embedding_dedup.SQL, "op10_mixing": mixing.SQL, "op11_merkle": merkle.SQL, "op12_decontamination": decontaminate.SQL}
