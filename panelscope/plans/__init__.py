"""Registered query plans over the test data and their DuckDB oracles."""

from panelscope.plans.registry import REGISTRY, Ctx, as_callable


def _load_all() -> None:
    # importing the modules registers their queries
    from panelscope.plans import (  # noqa: F401
        q_cleaning,
        q_distribution,
        q_features,
        q_metrics,
        q_model,
        q_quality,
        q_selection,
        q_sources,
        q_audits,
        q_reports,
        q_breakdowns,
    )


def all_queries() -> dict:
    _load_all()
    return {n: as_callable(q) for n, q in REGISTRY.items()}


def all_oracles() -> dict:
    _load_all()
    return {n: q.sql for n, q in REGISTRY.items() if q.sql is not None}


__all__ = ["REGISTRY", "Ctx", "all_queries", "all_oracles"]
