"""Driver queries over the test tables."""

from importlib import import_module

MODULES = ["file_queries", "report_queries", "text_queries", "search_queries", "hybrid_queries", "project_queries",
           "review_queries"]


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"filarium.plans.{name}")
