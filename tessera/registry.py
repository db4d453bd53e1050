"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import gc_and_refs, queueing, scalars, snapshots, status, storage, streams  # noqa: F401  (they register)
from tessera.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
