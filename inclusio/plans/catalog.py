"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import q_decide, q_encode, q_models, q_prepare, q_profile, q_scale  # noqa: F401
from .registry import REGISTRY


def queries():
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}


def bench_keys():
    return [k for k, q in REGISTRY.items() if q.bench]
