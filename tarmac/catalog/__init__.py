"""All registered queries, one module per group of operators."""

from __future__ import annotations

from tarmac.catalog.registry import ORACLES, QUERIES

_loaded = False


def _load() -> None:
    global _loaded
    if _loaded:
        return
    from tarmac.catalog import (  # noqa: F401  (modules register on import)
        aggregates,
        balancing,
        cleaning,
        engineered,
        evaluation,
        imputing,
        integration,
        learning,
        quality_checks,
        scans,
        scalars,
        streams,
    )

    _loaded = True


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
