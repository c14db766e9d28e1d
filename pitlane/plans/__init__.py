"""Registered queries over the given tables."""


def load_all() -> None:
    """Import every module that registers queries."""
    from pitlane.plans import (  # noqa: F401
        queries_ablation, queries_books, queries_files, queries_joins, queries_models, queries_panel, queries_signals,
        queries_sources,
    )
