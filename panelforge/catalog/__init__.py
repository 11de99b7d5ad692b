"""Registered queries and the SQL that checks them."""

from . import correlating, featuring, modelling, outlying, profiling, shaping, sourcing

MODULES = [profiling, featuring, outlying, shaping, correlating, modelling, sourcing]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
