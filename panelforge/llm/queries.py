"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import q_bpe, q_exact, q_langid, q_licences, q_lloyd, q_lm, q_mixing, q_ranking, q_simhash, q_tokens, q_toxicity, q_urls, q_vectors

MODULES = [q_vectors, q_mixing, q_exact, q_tokens, q_lm, q_licences, q_simhash, q_bpe, q_urls, q_toxicity, q_ranking, q_lloyd, q_langid]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
