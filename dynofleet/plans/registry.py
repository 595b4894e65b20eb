"""All registered queries of the engine-tuning side, and their SQL."""

from __future__ import annotations

from dynofleet.plans import analyses, dense, flash, records, sparse, stored

MODULES = (dense, sparse, records, analyses, flash, stored)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
