"""The registered queries of the library."""

from __future__ import annotations

from gridloom.plans import agents, codec, corpus, evaluation, files, layers, prompts, quantization  # noqa: F401
from gridloom.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
