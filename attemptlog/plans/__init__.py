"""Registered queries (one per operator family of the inventory) and their oracles."""

from attemptlog.plans.registry import ORACLE, QUERIES, finalize, register  # noqa: F401


def load_all():
    """Import every query module so that it registers itself."""
    from attemptlog.plans import (q_attempts, q_encode, q_features, q_files, q_history, q_jobs, q_lines,  # noqa: F401
                                  q_more, q_rollup, q_splits, q_text)
    return QUERIES, ORACLE
